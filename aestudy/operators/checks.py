"""Checks on columns, keys and sizes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(columns: Iterable[str], required: Iterable[str]) -> None:
    present = set(columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_strings(df: DataFrame, columns: Iterable[str]) -> None:
    columns = list(columns)
    require_columns(df.columns, columns)
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    if wrong:
        raise TypeError(f"columns must be strings: {wrong}")


@dataclass(frozen=True)
class SchemaSplit:
    """Column names by role, each list in schema order."""

    strings: list[str]
    numbers: list[str]
    response: list[str]


def split_schema(df: DataFrame, response: Sequence[str]) -> SchemaSplit:
    require_columns(df.columns, response)
    features = [f for f in df.schema.fields if f.name not in set(response)]
    strings = [f.name for f in features if isinstance(f.dataType, T.StringType)]
    return SchemaSplit(
        strings=strings,
        numbers=[f.name for f in features if f.name not in set(strings)],
        response=list(response),
    )


def cast_like(df: DataFrame, template: T.StructType) -> DataFrame:
    """Cast the columns that ``template`` also has to its types; values that do not fit become NULL."""
    types = {f.name: f.dataType for f in template.fields}
    casts = {
        f.name: F.col(f.name).try_cast(types[f.name])
        for f in df.schema.fields
        if f.name in types and types[f.name] != f.dataType
    }
    return df.withColumns(casts) if casts else df


def known_levels_only(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Turn levels that training has not seen into NULL, in the columns that ``levels`` names."""
    require_columns(df.columns, list(levels))
    return df.withColumns({c: F.when(F.col(c).isin(list(seen)), F.col(c)) for c, seen in levels.items()}) if levels else df


def cast_failures(df: DataFrame, template: T.StructType) -> DataFrame:
    """One row with the number of values per column that ``cast_like`` turns into NULL."""
    cast = cast_like(df, template)
    changed = [f.name for f in df.schema.fields if f.dataType != cast.schema[f.name].dataType]
    lost = {f"__{c}": F.col(c).isNotNull() for c in changed}
    present = cast_like(df.withColumns(lost), template) if lost else df
    return present.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"__{c}") & F.col(c).isNull()).alias(c) for c in changed])


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns)) if columns else df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


@dataclass(frozen=True)
class KeyProfile:
    n_rows: int
    max_rows_per_key: int
    n_repeated: int = 0
    n_bytes: int = 0


def key_profiles(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[KeyProfile]:
    """Size of every table and of its largest key group, from one job for all.

    Bytes are those of the keys as text, with what a hashed row takes beside them.
    """
    parts = None
    for i, (df, keys) in enumerate(tables):
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        width = F.lit(64)
        for key in keys:
            width = width + F.lit(8) + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
        part = sizes.agg(
            F.lit(i).alias("place"),
            F.sum("n").alias("n_rows"),
            F.max("n").alias("most"),
            F.count_if(F.col("n") > 1).alias("repeated"),
            F.sum(width * F.col("n")).alias("bytes"),
        )
        parts = part if parts is None else parts.unionByName(part)
    rows = [] if parts is None else parts.orderBy("place").collect()
    return [KeyProfile(r["n_rows"] or 0, r["most"] or 0, r["repeated"] or 0, r["bytes"] or 0) for r in rows]
