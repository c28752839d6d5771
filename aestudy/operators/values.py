"""Levels, ranges and quantiles of one column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_levels(df: DataFrame, column: str, max_levels: int | None = None) -> list:
    """Sorted distinct non-NULL values; more than ``max_levels``, where given, raise instead of being gathered."""
    return [v for v in levels_of(df, [column], max_levels)[column] if v is not None]


def levels_of(df: DataFrame, columns: Sequence[str], max_levels: int | None = None) -> dict[str, list]:
    """Sorted distinct values of several columns of one type, NULL last where it occurs.

    One job reads them all: values are paired with their column's number and deduplicated before
    the shuffle. A column with more than ``max_levels`` levels, where that is given, raises.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col("`" + c + "`").alias("v")) for i, c in enumerate(columns)])
    distinct = df.select(F.inline(pairs)).distinct()
    rows = (distinct if max_levels is None else distinct.limit((max_levels + 1) * len(columns) + 1)).collect()
    found: dict[str, list] = {c: [] for c in columns}
    nulls = set()
    for r in rows:
        if r["v"] is None:
            nulls.add(columns[r["c"]])
        else:
            found[columns[r["c"]]].append(r["v"])
    for c, values in found.items():
        if max_levels is not None and len(values) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} levels")
        values.sort()
    return {c: values + [None] * (c in nulls) for c, values in found.items()}


def baseline_levels(df: DataFrame, column: str, baseline: str, max_levels: int | None = None) -> list[str]:
    """Category levels with the baseline first and the others sorted."""
    return baseline_first(collect_levels(df, column, max_levels), baseline)


def baseline_first(levels: Sequence[str | None], baseline: str | None) -> list[str]:
    """Levels without NULL, the baseline (whether seen or not) moved to the front."""
    seen = [v for v in levels if v is not None]
    return seen if baseline is None else [baseline] + [v for v in seen if v != baseline]


def integer_range(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Smallest and largest value of each column as integers, from one pass."""
    if not columns:
        return {}
    row = df.agg(
        *[F.min(c).cast("long").alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("long").alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    ranges = {}
    for i, c in enumerate(columns):
        if row[f"lo_{i}"] is None:
            raise ValueError(f"column {c!r} has no value")
        ranges[c] = (row[f"lo_{i}"], row[f"hi_{i}"])
    return ranges


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Every integer from the smallest to the largest value, unseen ones included."""
    bounds = df.agg(F.min(column).cast("long").alias("lo"), F.max(column).cast("long").alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias(column))


def first_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a value of each column that does not depend on row order: the smallest."""
    return df.agg(*[F.min(c).alias(c) for c in columns])


def distinct_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], lower: float, upper: float) -> list[float]:
    """Exact linear-interpolation quantiles of the distinct values within two bounds.

    The order statistics are found by counting values in ever narrower slices, so no task and no
    driver step ever holds the values, however many there are.
    """
    value = F.col(column).cast("double")
    distinct = df.where(value.between(lower, upper)).select(value.alias("v")).distinct().persist()
    try:
        slices = _slices(distinct, float(lower), float(upper))
        if not slices:
            raise ValueError(f"column {column!r} has no value between {lower} and {upper}")
        places = [p * (sum(r["n"] for r in slices) - 1) for p in probabilities]
        ranks = {r for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}
        at = {r: _order_statistic(distinct, r, slices) for r in ranks}
    finally:
        distinct.unpersist()
    return [at[lo] + (at[int(np.ceil(p))] - at[lo]) * (p - lo) for p in places for lo in [int(np.floor(p))]]


def _slices(distinct: DataFrame, lo: float, hi: float, slices: int = 1024) -> list:
    """Number, smallest and largest of the values in each non-empty slice of ``[lo, hi]``, in order."""
    width = F.lit((hi - lo) / slices or 1.0)
    number = F.least(F.floor((F.col("v") - F.lit(lo)) / width), F.lit(slices - 1))
    counted = distinct.where(F.col("v").between(lo, hi)).groupBy(number.alias("s"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()


def _order_statistic(distinct: DataFrame, rank: int, slices: Sequence) -> float:
    """The value with ``rank`` smaller ones, among the distinct values that the slices count."""
    while True:
        for row in slices:
            if rank < row["n"]:
                break
            rank -= row["n"]
        if row["n"] <= 2:
            return float(row["lo"] if rank == 0 else row["hi"])
        slices = _slices(distinct, row["lo"], row["hi"])
