"""Names and literals as SQL text.

Iterative fits build the same few expressions again and again; as text each is one call into the
JVM instead of one per operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterable


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def string(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    value = float(value)
    if not math.isfinite(value):
        spelled = "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
        return f"CAST('{spelled}' AS DOUBLE)"
    return f"{value!r}D"


def numbers(values: Iterable[float]) -> str:
    return "array(" + ", ".join(number(v) for v in values) + ")"


def integers(values: Iterable[int]) -> str:
    return "array(" + ", ".join(str(int(v)) for v in values) + ")"


def strings(values: Iterable[str]) -> str:
    return "(" + ", ".join(string(v) for v in values) + ")"
