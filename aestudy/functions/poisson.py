"""Poisson deviance as Column expressions.

With one rate per group the deviance needs four sums that add over partitions, cells and nodes:
``sum(y)``, ``sum(e)``, ``sum(y ln(y/e))`` and a row count, so no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_FLOOR = 1e-15


def y_log_ratio(y: Column, base: Column) -> Column:
    """``y ln(y / base)``, and 0 where ``y`` is 0."""
    return F.when(y > 0, y * F.ln(F.try_divide(y, base))).otherwise(F.lit(0.0))


def unit_deviance(y: Column, mu: Column) -> Column:
    return F.lit(2.0) * (y_log_ratio(y, mu) - (y - mu))


def group_deviance(sum_y: Column, sum_e: Column, sum_y_log: Column) -> Column:
    """Deviance of a group whose fitted mean is exposure times the group's own rate."""
    rate = F.greatest(F.try_divide(sum_y, sum_e), F.lit(RATE_FLOOR))
    return F.lit(2.0) * (sum_y_log - sum_y * F.ln(rate) - (sum_y - sum_e * rate))


def fail_unless(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error when the (non-NULL) condition is false."""
    return F.when(F.coalesce(condition, F.lit(True)), value).otherwise(
        F.raise_error(F.lit(message)).cast("double")
    )


def usable_counts(actual: Column, exposure: Column) -> Column:
    """Whether a row has an actual count and a positive exposure."""
    return F.coalesce((exposure > 0) & (actual >= 0) & ~F.isnan(actual.cast("double")), F.lit(False))
