"""Many-to-one lookups and comparisons of key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.operators.checks import KeyProfile, duplicate_keys, key_profiles, require_columns
from aestudy.sources.checkpoints import cut_lineage

#: Estimated size up to which a lookup table is sent to all executors; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def many_to_one_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    output: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join that adds ``table[value]`` as ``output``; a repeated key on the right raises.

    The table is made once, measured while its keys are checked, and broadcast only up to an estimated
    ``broadcast_bytes``. A larger one is joined by a shuffle on the keys, where adaptive execution splits the partitions
    of hot keys. NULL keys match NULL.
    """
    require_columns(df.columns, keys)
    require_columns(table.columns, [*keys, value])
    table = cut_lineage(table.select(*keys, value))
    (profile,) = unique_key_profiles([(table, keys)])
    return lookup(df, table, keys, value, output, profile, broadcast_bytes)


def unique_key_profiles(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[KeyProfile]:
    """Sizes of lookup tables; raises if one of them repeats a key."""
    profiles = key_profiles(tables)
    for (table, keys), profile in zip(tables, profiles):
        if profile.max_rows_per_key > 1:
            sample = duplicate_keys(table, keys).orderBy(*keys).limit(5).collect()
            raise ValueError(f"{profile.n_repeated} lookup keys are not unique, such as {[r.asDict() for r in sample]}")
    return profiles


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    output: str,
    profile: KeyProfile,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    right = table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__value"))
    right = F.broadcast(right) if profile.n_bytes <= broadcast_bytes else right.hint("merge")
    matches = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    kept = [c for c in df.columns if c != output]
    return df.join(right, on=matches, how="left").select(*kept, F.col("__value").alias(output))


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``side`` is ``missing`` (left only) or ``unexpected`` (right only)."""
    missing = left.select(key).join(right.select(key), key, "left_anti").select(F.lit("missing").alias("side"), key)
    unexpected = right.select(key).join(left.select(key), key, "left_anti").select(F.lit("unexpected").alias("side"), key)
    return missing.unionByName(unexpected)
