"""Natural cubic regression splines (Wood 2006, section 4.1.2) as Column expressions.

The knots and the small matrix that maps knot values to second derivatives live on the driver.
On each piece between two knots a basis function is one cubic, so a row costs one comparison chain
and a Horner evaluation; outside the bounds it continues as a straight line.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def second_derivative_map(knots: Sequence[float]) -> np.ndarray:
    """Matrix that gives the second derivative at every knot from the values at the knots."""
    k = np.asarray(knots, dtype=float)
    m, h = len(k), np.diff(k)
    d = np.zeros((m - 2, m))
    b = np.zeros((m - 2, m - 2))
    for i in range(m - 2):
        d[i, i : i + 3] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < m - 2:
            b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
    inner = np.linalg.solve(b, d) if m > 2 else np.zeros((0, m))
    return np.vstack([np.zeros(m), inner, np.zeros(m)])


def piece_polynomials(knots: Sequence[float]) -> list[tuple[float, np.ndarray]]:
    """One ``(origin, coefficients)`` per piece: below, between neighbouring knots, above.

    ``coefficients[p, i]`` multiplies ``(x - origin) ** p`` in basis function ``i``.
    """
    k = np.asarray(knots, dtype=float)
    m, h, curve = len(k), np.diff(k), second_derivative_map(knots)
    value = np.eye(m)
    pieces = []
    for j in range(m - 1):
        slope = (value[j + 1] - value[j]) / h[j] - h[j] * (2 * curve[j] + curve[j + 1]) / 6
        cubic = (curve[j + 1] - curve[j]) / (6 * h[j])
        pieces.append((float(k[j]), np.vstack([value[j], slope, curve[j] / 2, cubic])))
    flat = np.zeros((2, m))
    first = pieces[0][1]
    last_slope = (value[m - 1] - value[m - 2]) / h[-1] + h[-1] * (curve[m - 2] + 2 * curve[m - 1]) / 6
    below = (float(k[0]), np.vstack([first[:2], flat]))
    above = (float(k[-1]), np.vstack([value[m - 1], last_slope, flat]))
    return [below, *pieces, above]


def basis_columns(x: Column, knots: Sequence[float]) -> list[Column]:
    """The basis functions at ``x``; NULL stays NULL."""
    x = x.cast("double")
    pieces = piece_polynomials(knots)
    out = []
    for i in range(len(knots)):
        basis = None
        for upper, (origin, coef) in zip(knots, pieces):
            part = _horner(x - F.lit(origin), coef[:, i])
            basis = F.when(x < F.lit(float(upper)), part) if basis is None else basis.when(x < F.lit(float(upper)), part)
        origin, coef = pieces[-1]
        above = _horner(x - F.lit(origin), coef[:, i])
        out.append(F.when(x.isNotNull(), basis.otherwise(above)))
    return out


def _horner(t: Column, coef: np.ndarray) -> Column:
    top = max((p for p in range(len(coef)) if coef[p] != 0.0), default=0)
    value = F.lit(float(coef[top]))
    for p in range(top - 1, -1, -1):
        value = value * t + F.lit(float(coef[p]))
    return value
