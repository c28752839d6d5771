"""Poisson deviance and explained deviance of prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy.functions.poisson import fail_unless, unit_deviance, y_log_ratio

NOT_POSITIVE = "all fitted means must be positive"


def poisson_deviance(
    df: DataFrame, actual: str, predicted: Column | str, by: Sequence[str] = (), output: str = "deviance"
) -> DataFrame:
    """Total Poisson deviance, overall or per group; a fitted mean that is not positive raises."""
    mu = F.col(predicted) if isinstance(predicted, str) else predicted
    y = F.col(actual)
    measure = F.sum(fail_unless(mu > 0, NOT_POSITIVE, unit_deviance(y, mu))).alias(output)
    return df.groupBy(*by).agg(measure) if by else df.agg(measure)


def null_deviance(n: Column, sum_y: Column, sum_y_log_y: Column) -> Column:
    """Deviance of the model that predicts the mean count on every row."""
    return F.lit(2.0) * (sum_y_log_y - F.when(sum_y > 0, sum_y * F.ln(sum_y / n)).otherwise(F.lit(0.0)))


def d2_score(
    df: DataFrame, actual: str, predicted: Column | str, by: Sequence[str] = (), output: str = "d2"
) -> DataFrame:
    """Share of the null deviance that a prediction explains, in one pass.

    The null model predicts the mean count and knows no offset. With fewer than two rows, or a null
    deviance of zero, the score is NULL.
    """
    mu = F.col(predicted) if isinstance(predicted, str) else predicted
    y = F.col(actual)
    sums = [
        F.count(F.lit(1)).alias("__n"),
        F.sum(y).alias("__y"),
        F.sum(y_log_ratio(y, F.lit(1.0))).alias("__yly"),
        F.sum(fail_unless(mu > 0, NOT_POSITIVE, unit_deviance(y, mu))).alias("__dev"),
    ]
    totals = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    null = null_deviance(F.col("__n"), F.col("__y"), F.col("__yly"))
    score = F.when(F.col("__n") >= 2, F.lit(1.0) - F.try_divide(F.col("__dev"), null))
    return totals.select(*by, score.alias(output))
