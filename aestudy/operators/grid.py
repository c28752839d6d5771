"""Combinations of the values of some variables: all of them, or those that occur."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aestudy.operators.checks import require_columns
from aestudy.operators.values import integer_range, levels_of
from aestudy.sources.checkpoints import cut_lineage


@dataclass(frozen=True)
class Axis:
    """The values of one variable: integers in steps of one, or a list of levels."""

    name: str
    data_type: T.DataType
    start: int = 0
    size: int = 0
    levels: tuple[str, ...] | None = None

    def value(self, place: Column) -> Column:
        if self.levels is None:
            return (place + F.lit(self.start)).cast(self.data_type)
        return F.element_at(F.array(*[F.lit(v) for v in self.levels]), (place + 1).cast("int"))


def grid_axes(df: DataFrame, variables: Sequence[str]) -> dict[str, Axis]:
    """Values of each variable in ``df``: whole integer ranges, and levels that occur."""
    require_columns(df.columns, variables)
    types = {v: df.schema[v].dataType for v in variables}
    strings = [v for v in variables if isinstance(types[v], T.StringType)]
    numbers = [v for v in variables if v not in strings]
    axes = {}
    for v, (lo, hi) in integer_range(df, numbers).items():
        axes[v] = Axis(v, types[v], start=lo, size=hi - lo + 1)
    for v, found in levels_of(df, strings).items():
        levels = tuple(x for x in found if x is not None)
        if not levels:
            raise ValueError(f"column {v!r} has no value")
        axes[v] = Axis(v, types[v], size=len(levels), levels=levels)
    return {v: axes[v] for v in variables}


def prediction_grid(
    spark: SparkSession, axes: Sequence[Axis], max_rows: int | None = None
) -> DataFrame:
    """The product of the axes, first variable slowest.

    The row number is read as a number with one digit per variable, so executors write the rows
    down directly and no join takes place. A grid over ``max_rows``, where given, raises before any work.
    """
    n_rows = prod(a.size for a in axes)
    if max_rows is not None and n_rows > max_rows:
        raise ValueError(f"the grid over {[a.name for a in axes]} has {n_rows} rows, more than {max_rows}")
    columns, stride = [], n_rows
    for axis in axes:
        stride //= axis.size
        place = F.floor(F.col("id") / F.lit(stride)) % F.lit(axis.size)
        columns.append(axis.value(place).alias(axis.name))
    return spark.range(n_rows).select(*columns)


def occurring_combinations(df: DataFrame, groups: Sequence[Sequence[str]]) -> list[DataFrame]:
    """For every group of variables, the combinations without NULL that occur in ``df``, once each.

    All groups come from one pass, as grouping sets: combinations are deduplicated before the shuffle, so a
    frequent one sends one row per task. They are written down once. There are never more than ``df`` has
    rows, however wide the ranges of the variables are.
    """
    names = list(dict.fromkeys(v for group in groups for v in group))
    require_columns(df.columns, names)
    columns = {v: F.col("`" + v + "`") for v in names}
    # Bit i counts from the last name; it is set where a name is not in the grouping set.
    masks = [sum(1 << i for i, v in enumerate(reversed(names)) if v not in group) for group in groups]
    sets = {mask: [columns[v] for v in group] for mask, group in zip(masks, groups)}
    grouped = df.groupingSets(list(sets.values()), *columns.values()).agg(F.grouping_id().alias("__set"))
    found = cut_lineage(grouped)
    return [
        found.where(F.col("__set") == mask).where(reduce(and_, [columns[v].isNotNull() for v in group])).select(*[columns[v] for v in group])
        for mask, group in zip(masks, groups)
    ]
