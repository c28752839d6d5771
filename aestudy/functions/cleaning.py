"""String cleaning, level collapsing and banding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aestudy import columns as C


def clean_strings(df: DataFrame) -> DataFrame:
    """Upper-case and strip the spaces of every string column; other columns pass through."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    return df.withColumns({c: F.upper(F.trim(F.col(_quoted(c)))) for c in strings})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column, so that comparisons treat it as missing."""
    floats = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns(
        {f.name: F.nanvl(F.col(_quoted(f.name)), F.lit(None).cast(f.dataType)) for f in floats}
    )


def collapse_levels(df: DataFrame, column: str, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace source values by their target, in mapping order.

    Each step sees the output of the one before it. Values that no step names, and NULL, stay.
    """
    collapsed = F.col(_quoted(column))
    for target, sources in mapping.items():
        collapsed = F.when(collapsed.isin(list(sources)), F.lit(target)).otherwise(collapsed)
    return df.withColumn(column, collapsed)


@dataclass(frozen=True)
class Band:
    """Values above ``above`` (or from ``at_least``) up to and with ``at_most``."""

    label: str
    above: float | None = None
    at_least: float | None = None
    at_most: float | None = None

    def holds(self, value: Column) -> Column:
        condition = F.lit(True)
        if self.above is not None:
            condition = condition & (value > self.above)
        if self.at_least is not None:
            condition = condition & (value >= self.at_least)
        if self.at_most is not None:
            condition = condition & (value <= self.at_most)
        return condition


# Issue-year bands.
ISSUE_YEAR_BANDS = [
    Band("≤1980", at_most=1980),
    Band("1981-1996", above=1980, at_most=1996),
    Band("1997-2003", at_least=1997, at_most=2003),
    Band("2004-2008", at_least=2004, at_most=2008),
    Band("2009+", at_least=2009),
]
UNKNOWN_BAND = "Unknown"


def band_column(
    df: DataFrame,
    column: str,
    output: str,
    bands: Sequence[Band],
    default: str = UNKNOWN_BAND,
) -> DataFrame:
    """Label each value with the first band that holds it; NULL and gaps get ``default``."""
    value = F.col(_quoted(column))
    label = None
    for band in bands:
        holds = band.holds(value) & value.isNotNull()
        label = F.when(holds, F.lit(band.label)) if label is None else label.when(holds, F.lit(band.label))
    return df.withColumn(output, F.lit(default) if label is None else label.otherwise(F.lit(default)))


def band_issue_year(df: DataFrame) -> DataFrame:
    return band_column(df, C.ISSUE_YEAR, C.ISSUE_YEAR_GROUP, ISSUE_YEAR_BANDS)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
