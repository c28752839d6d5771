"""Dictionaries of category levels that never pass the driver.

Sorted distinct values are numbered where they lie: a range partitioning puts them in order, each task
numbers its own, and the sizes of the partitions before it are added. Only those sizes reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.operators.checks import KeyProfile, key_profiles, require_columns
from aestudy.operators.lookup import BROADCAST_BYTES, lookup
from aestudy.sources.checkpoints import cut_lineage

#: Rows of a partition are counted in the low bits of Spark's increasing identifiers.
ROW_BITS = 33


@dataclass
class LevelDictionary:
    """The levels of one column and their positions in sorted order, from 0, as a table."""

    column: str
    table: DataFrame  # level, position
    n_levels: int
    profile: KeyProfile

    def encode(self, df: DataFrame, output: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add the position of every row's level; NULL for NULL and for levels that were not seen."""
        return self.attach(df, self.table, "position", output, broadcast_bytes)

    def attach(self, df: DataFrame, values: DataFrame, value: str, output: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add a value that ``values`` holds per level; the table is broadcast up to ``broadcast_bytes``, else joined by a shuffle."""
        named = values.select(F.col("level").alias(self.column), value)
        return lookup(df, named, [self.column], value, output, self.profile, broadcast_bytes)


def level_dictionary(df: DataFrame, column: str) -> LevelDictionary:
    """Number the distinct non-NULL values of a column in their order; without any, the dictionary is empty."""
    require_columns(df.columns, [column])
    level = F.col("`" + column + "`")
    distinct = df.where(level.isNotNull()).select(level.alias("level")).distinct()
    ordered = distinct.repartitionByRange("level").sortWithinPartitions("level")
    numbered = cut_lineage(ordered.select("level", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before = [0, *accumulate(r["n"] for r in sizes)]
    start = numbered.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, before long")
    in_part = F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    table = numbered.join(F.broadcast(start), "part").select("level", (F.col("before") + in_part).alias("position"))
    (profile,) = key_profiles([(table, ["level"])])
    return LevelDictionary(column, table, before[-1], profile)
