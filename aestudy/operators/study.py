"""Selecting a study, splitting it, and aggregating actual and expected counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.checks import require_columns


def select_study(
    df: DataFrame,
    plan: str = C.TERM_PLAN,
    excluded_level: str = C.POST_LEVEL_EXCLUDED,
    cleaned: bool = False,
) -> DataFrame:
    """Rows of one plan, without one post-level mark, that carry a positive expected count.

    A NULL in any of the three columns drops the row. On a cleaned table say ``cleaned=True``:
    the plan is then compared without ``trim`` and all three conditions reach the file scan.
    """
    require_columns(df.columns, [C.PLAN, C.POST_LEVEL, C.EXPECTED])
    plan_column = F.col(C.PLAN) if cleaned else F.trim(F.col(C.PLAN))
    return df.filter(
        (plan_column == F.lit(plan))
        & (F.col(C.POST_LEVEL) != F.lit(excluded_level))
        & (F.col(C.EXPECTED) > F.lit(0.0))
    )


def label_dataset(
    df: DataFrame, year: str = C.OBSERVATION_YEAR, last_train_year: int = C.LAST_TRAIN_YEAR
) -> DataFrame:
    """Mark rows up to ``last_train_year`` as training rows, all others (NULL years too) as test."""
    is_train = F.col(year) <= F.lit(last_train_year)
    return df.withColumn(C.DATASET, F.when(is_train, F.lit(C.TRAIN)).otherwise(F.lit(C.TEST)))


def subset(df: DataFrame, dataset: str) -> DataFrame:
    return df.filter(F.col(C.DATASET) == F.lit(dataset))


def aggregate_study(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (C.ACTUAL, C.EXPECTED)
) -> DataFrame:
    """Sum counts over every combination of ``keys``; NULL is a key value of its own."""
    require_columns(df.columns, [*keys, *sums])
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def study_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training and test cells from one pass: the label is one more key.

    Callers that use the cells more than once should ``persist`` them.
    """
    return aggregate_study(df, [C.DATASET, *keys])


def predicted_count(prediction: str = C.PREDICTION, expected: str = C.EXPECTED) -> Column:
    """A model's multiplier of expected, as a count."""
    return F.col(prediction) * F.col(expected)


def actual_to_predicted(
    df: DataFrame,
    predicted: Column | str = C.EXPECTED,
    actual: str = C.ACTUAL,
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count, totals and both ratios of actual and predicted, overall or per group.

    The direction is in the name: ``actual_over_predicted`` is A/E, ``predicted_over_actual`` its
    inverse. A ratio with a zero denominator is NULL.
    """
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    totals = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(actual).alias("actual"),
        F.sum(predicted).alias("predicted"),
    ]
    grouped = df.groupBy(*by).agg(*totals) if by else df.agg(*totals)
    return grouped.withColumns(
        {
            "actual_over_predicted": F.try_divide(F.col("actual"), F.col("predicted")),
            "predicted_over_actual": F.try_divide(F.col("predicted"), F.col("actual")),
        }
    )


def prediction_difference(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """How far two prediction columns are apart, and how many rows lack one of them."""
    measures = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(left).isNull() | F.col(right).isNull()).alias("n_missing"),
        F.max(F.abs(F.col(left) - F.col(right))).alias("max_abs_diff"),
        F.max(F.try_divide(F.abs(F.col(left) - F.col(right)), F.abs(F.col(right)))).alias("max_rel_diff"),
    ]
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def all_close(df: DataFrame, left: str, right: str, rtol: float, atol: float) -> bool:
    """True if no row lacks a value and ``|left - right| <= atol + rtol |right|`` on every row."""
    apart = F.abs(F.col(left) - F.col(right)) > (F.lit(atol) + F.lit(rtol) * F.abs(F.col(right)))
    bad = F.coalesce(apart, F.lit(True)) | F.isnan(F.col(left)) | F.isnan(F.col(right))
    return df.agg(F.count_if(bad).alias("n_bad")).first()["n_bad"] == 0
