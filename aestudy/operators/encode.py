"""Indicator, ordinal and learned encodings as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.checks import require_columns, require_strings
from aestudy.operators.values import levels_of

NULL_LEVEL = "None"


def indicator(column: str, level: str | None) -> Column:
    """1.0 where the column equals the level, else 0.0; NULL counts as a level of its own."""
    return F.col(column).eqNullSafe(F.lit(level).cast("string")).cast("double")


def indicator_name(column: str, level: str | None, levels: Sequence[str | None] = ()) -> str:
    """Column and level; NULL is called ``None``, with underscores behind while a level has that name."""
    if level is None:
        level = NULL_LEVEL
        while level in levels:
            level += "_"
    return f"{column}_{level}"


def one_hot(df: DataFrame, column: str, levels: Sequence[str | None], drop_first: bool = True) -> DataFrame:
    """Add one indicator per level of a given list; values outside the list are zero everywhere."""
    require_strings(df, [column])
    used = list(levels)[1:] if drop_first else list(levels)
    return df.withColumns({indicator_name(column, v, levels): indicator(column, v) for v in used})


def learned_levels(df: DataFrame, column: str, max_levels: int | None = None) -> list[str | None]:
    """Sorted levels of the data; NULL, where it occurs, is the last level."""
    require_strings(df, [column])
    return levels_of(df, [column], max_levels)[column]


def ordinal(column: str, levels: Sequence[str], unknown: int = -1) -> Column:
    """Position of the value in an ordered list, from 0; other values and NULL get ``unknown``."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return F.when(position > 0, position - 1).otherwise(F.lit(unknown)).cast("double")


@dataclass(frozen=True)
class EncodedColumn:
    """One numeric model column: an indicator, a position in an ordered list, or a number as it is."""

    name: str
    source: str
    kind: str
    levels: tuple[str | None, ...] = ()

    def value(self) -> Column:
        if self.kind == "indicator":
            return indicator(self.source, self.levels[0])
        if self.kind == "ordinal":
            return ordinal(self.source, self.levels)
        return F.col(self.source).cast("double")


def one_hot_columns(column: str, levels: Sequence[str | None], drop_first: bool = True) -> list[EncodedColumn]:
    used = list(levels)[1:] if drop_first else list(levels)
    return [EncodedColumn(indicator_name(column, v, levels), column, "indicator", (v,)) for v in used]


def ordinal_column(column: str, levels: Sequence[str]) -> EncodedColumn:
    return EncodedColumn(column, column, "ordinal", tuple(levels))


def number_column(column: str) -> EncodedColumn:
    return EncodedColumn(column, column, "number")


def study_encoding() -> list[EncodedColumn]:
    """The fixed encoding of the boosted study model."""
    return [
        *one_hot_columns(C.SEX, C.SEX_LEVELS),
        *one_hot_columns(C.SMOKER, C.SMOKER_LEVELS),
        ordinal_column(C.FACE_BAND, C.FACE_BAND_LEVELS),
        number_column(C.ATTAINED_AGE),
    ]


def encode(df: DataFrame, encoding: Sequence[EncodedColumn], keep: Sequence[str] = ()) -> DataFrame:
    """The encoded columns in order, after the columns to keep; everything else is dropped."""
    require_columns(df.columns, [*keep, *[e.source for e in encoding]])
    return df.select(*keep, *[e.value().alias(e.name) for e in encoding])
