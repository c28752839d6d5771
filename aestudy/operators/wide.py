"""Poisson regression with categories of very many levels, by matrix-free Newton steps.

A wide category is a main effect with one coefficient per level, beside the ordinary terms of a core
design. Levels are numbered by a distributed dictionary; cells carry the numbers, not indicators. No
Hessian is ever built. The coefficients of a single wide category are a table that cells are joined with, of any
length (``wide_levels``). With several wide categories, or a core of more than ``ELIMINATED_CORE`` columns, Newton's
equations are solved by conjugate gradients with the diagonal as preconditioner, each product of Hessian and vector
being one pass in which tasks add up their own cells. There the driver and every task hold vectors with one number
per coefficient and open penalty, at most ``SUMS_PER_PASS`` of them or one penalty's (``MAX_COEFFICIENTS``, 80 MB);
more coefficients raise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.checks import require_columns, require_strings
from aestudy.operators.design import Cat, Design
from aestudy.operators.dictionary import LevelDictionary, level_dictionary
from aestudy.operators.glm import CELLS_PER_TASK, INTERCEPT, SUMS_PER_PASS, merge_cells, penalty_path
from aestudy.operators.wide_levels import core_columns, solve_by_level
from aestudy.sources.checkpoints import cut_lineage

MAX_COEFFICIENTS = 10_000_000
#: Core columns up to which the levels of a single wide category are eliminated.
ELIMINATED_CORE = 16
#: Coefficients whose sums travel in one row between tasks.
BLOCK = 1 << 15
ROWS_AT_ONCE = 8_192


@dataclass
class WideDesign:
    """Core terms, and the dictionaries of the wide categories.

    Coefficients are ordered: intercept, core columns, then each wide category's levels. As in other designs the
    first categorical main effect keeps all its levels, and later ones drop the first.
    """

    core: Design
    dictionaries: list[LevelDictionary]

    def __post_init__(self) -> None:
        spanned = any(len(t) == 1 and isinstance(t[0], Cat) for t in self.core.terms)
        self.n_core = 1 + len(self.core.columns)
        self.offsets, self.dropped, at = [], [], self.n_core
        for d in self.dictionaries:
            self.dropped.append(int(spanned))
            self.offsets.append(at)
            at += max(0, d.n_levels - int(spanned))
            spanned = True
        self.size = at

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys([*self.core.variables, *[d.column for d in self.dictionaries]]))

    def complete(self) -> Column:
        whole = F.lit(True)
        for v in self.variables:
            whole = whole & F.col(v).isNotNull()
        return whole

    def encode(self, cells: DataFrame) -> DataFrame:
        """Add ``x`` (1 and the core features) and ``at`` (places of the wide coefficients, ``size`` for none)."""
        names = [f"__at_{i}" for i in range(len(self.dictionaries))]
        for d, name in zip(self.dictionaries, names):
            cells = d.encode(cells, name)
        places = [
            F.when(F.col(n) >= drop, F.col(n) - drop + first).otherwise(F.lit(self.size)).cast("long")
            for n, drop, first in zip(names, self.dropped, self.offsets)
        ]
        features = [self.core.feature(c).cast("double") for c in self.core.columns]
        with_basis = self.core.with_basis(cells)
        return with_basis.withColumns({"x": F.array(F.lit(1.0), *features), "at": F.array(*places)}).drop(*names)

    def keyed(self, cells: DataFrame) -> DataFrame:
        """Add ``x_1``, ``x_2``, ... (the core features) and ``key`` (the position of the only wide level, -1 for an unknown one)."""
        features = {f"x_{j}": self.core.feature(c).cast("double") for j, c in enumerate(self.core.columns, 1)}
        (d,) = self.dictionaries
        at = d.encode(self.core.with_basis(cells), "__at").withColumns(features)
        return at.withColumn("key", F.coalesce("__at", F.lit(-1)).cast("long")).drop("__at")

    def levels(self) -> DataFrame:
        """``(key, free)`` of the only wide category's levels and of the unknown one; ``free`` is 1 for those with a coefficient, else 0."""
        (d,), (drop,) = self.dictionaries, self.dropped
        unknown = d.table.sparkSession.createDataFrame([(-1, 0.0)], "key long, free double")
        return unknown.union(d.table.select("position", (F.col("position") >= drop).cast("double")))


def fit_wide_design(df: DataFrame, core: Design, wide: Sequence[str]) -> WideDesign:
    """Learn the levels of the wide categories."""
    if not wide:
        raise ValueError("a wide design needs a wide category")
    require_strings(df, wide)
    return WideDesign(core, [level_dictionary(df, c) for c in wide])


@dataclass
class WideModel:
    """Core coefficients along a penalty path, one row of ``core`` per penalty, and per wide category a table of its levels."""

    design: WideDesign
    alphas: list[float]
    core: np.ndarray
    tables: list[DataFrame]  # level, position, weights (one per penalty)
    n_rows: int

    @property
    def coefficients(self) -> np.ndarray:
        """All coefficients, one row per penalty. It brings every level to the driver; nothing here uses it."""
        parts = [self.core]
        for table, drop in zip(self.tables, self.design.dropped):
            rows = table.where(F.col("position") >= drop).orderBy("position").select("weights").collect()
            parts.append(np.array([r[0] for r in rows]).reshape(-1, len(self.alphas)).T)
        return np.hstack(parts)

    def weights(self, alpha_index: int = -1) -> list[DataFrame]:
        """``(level, weight)`` per wide category, all its levels."""
        place = range(len(self.alphas))[alpha_index]
        return [t.select("level", F.col("weights")[place].alias("weight")) for t in self.tables]

    def predict(self, df: DataFrame, alpha_index: int = -1, exposure: str | None = None, output: str = C.PREDICTION) -> DataFrame:
        """Add the fitted mean, or without ``exposure`` the multiplier of expected.

        Weights come by joins with one table per wide category. An unknown level counts as the baseline, and
        a row with a NULL feature gets NULL.
        """
        require_columns(df.columns, self.design.variables)
        core = self.design.core
        own = self.core[alpha_index]
        kept = [c for c in df.columns if c != output]
        score = F.lit(float(own[0]))
        if core.columns:
            score = score + core.linear_predictor(dict(zip(core.column_names, map(float, own[1:]))))
        rows = core.with_basis(df)
        for i, (d, weights) in enumerate(zip(self.design.dictionaries, self.weights(alpha_index))):
            rows = d.attach(rows, weights, "weight", f"__weight_{i}")
            score = score + F.coalesce(F.col(f"__weight_{i}"), F.lit(0.0))
        mean = F.exp(score) if exposure is None else F.exp(score) * F.col(exposure)
        return rows.select(*kept, F.when(self.design.complete(), mean).alias(output))

    def path_scores(self, df: DataFrame, actual: str = C.ACTUAL, expected: str = C.EXPECTED) -> DataFrame:
        """``(alpha_index, pos, score)``: the objective's derivative by every coefficient, zero at a fit."""
        design = self.design
        cells = cut_lineage(merge_cells(df, design, actual, expected))
        n = cells.agg(F.sum("n")).first()[0]
        features = {f"x_{j}": design.core.feature(c).cast("double") for j, c in enumerate(design.core.columns, 1)}
        parts = []
        for i, alpha in enumerate(self.alphas):
            rows = self.predict(cells, i, "e", "__mean").withColumn("r", F.col("__mean") - F.col("y"))
            pull = alpha * self.core[i]
            pull[0] = 0.0
            sums = [F.coalesce(F.sum(F.col("r") * x), F.lit(0.0)) for x in core_columns(design.n_core)]
            entries = [F.struct(F.lit(j).cast("long").alias("pos"), (s / n + float(p)).alias("score")) for j, (s, p) in enumerate(zip(sums, pull))]
            with_core = design.core.with_basis(rows).withColumns(features)
            parts.append(with_core.agg(F.array(*entries).alias("all")).select(F.lit(i).alias("alpha_index"), F.inline("all")))
            for d, table, first, drop in zip(design.dictionaries, self.tables, design.offsets, design.dropped):
                own = rows.groupBy(F.col(d.column).alias("level")).agg(F.sum("r").alias("s"))
                held = table.where(F.col("position") >= drop).join(own, "level", "left")
                score = F.coalesce(F.col("s"), F.lit(0.0)) / n + alpha * F.col("weights")[i]
                parts.append(held.select(F.lit(i).alias("alpha_index"), (F.col("position") - drop + first).alias("pos"), score.alias("score")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def fit_wide_path(
    df: DataFrame,
    design: WideDesign,
    alphas: Sequence[float] | None = None,
    actual: str = C.ACTUAL,
    expected: str = C.EXPECTED,
    tol: float = 1e-14,
    max_iter: int = 100,
) -> WideModel:
    """Fit the regression of ``fit_glm_path`` (same objective, free intercept) at every penalty.

    Rows with a NULL feature are left out. Without a table of coefficients cells are spread by the first wide category's places and a hash of the
    other features, so that a level with very many cells is split and tasks touch few blocks of coefficients.
    """
    require_columns(df.columns, [*design.variables, actual, expected])
    by_level = len(design.dictionaries) == 1 and design.n_core <= ELIMINATED_CORE
    if not by_level and design.size > MAX_COEFFICIENTS:
        raise ValueError(f"the design has {design.size} coefficients, the solver takes up to {MAX_COEFFICIENTS}")
    alphas = penalty_path() if alphas is None else [float(a) for a in alphas]
    if min(alphas) <= 0:
        raise ValueError("wide designs need positive penalties")
    cells = cut_lineage(merge_cells(df, design, actual, expected))
    totals = cells.agg(*[F.sum(c).alias(c) for c in ("y", "e", "n", "n_bad")], F.count(F.lit(1)).alias("n_cells")).first()
    if not totals["n"]:
        raise ValueError("there are no rows to fit a regression to")
    if totals["n_bad"]:
        raise ValueError(f"{totals['n_bad']} rows lack an actual or have a non-positive expected count")
    if not totals["y"] > 0:
        raise ValueError("the actual counts sum to zero")
    if by_level:
        rate = float(np.log(totals["y"] / totals["e"]))
        core, weights = solve_by_level(cells, design, alphas, rate, totals["n_cells"], totals["n"], tol, max_iter)
        return WideModel(design, alphas, core, [weights], int(totals["n"]))
    spread = 1 + totals["n_cells"] // CELLS_PER_TASK // 4
    encoded = design.encode(cells).withColumn("__salt", F.xxhash64(*design.variables))
    training = encoded.repartitionByRange(spread, F.col("at")[0], "__salt").select("y", F.ln("e").alias("log_e"), "x", "at").persist()
    start = np.zeros(design.size)
    start[0] = np.log(totals["y"] / totals["e"])
    at_once = max(1, SUMS_PER_PASS // design.size)
    try:
        fits = [_solve(training, design, np.array(alphas[i : i + at_once]), start, totals["n"], tol, max_iter) for i in range(0, len(alphas), at_once)]
    finally:
        training.unpersist()
    found = np.concatenate(fits)
    tables = []
    for d, first, drop in zip(design.dictionaries, design.offsets, design.dropped):
        held = np.hstack([np.zeros((len(alphas), min(drop, d.n_levels))), found[:, first : first + max(0, d.n_levels - drop)]])
        rows = pd.DataFrame({"position": np.arange(d.n_levels), "weights": held.T.tolist()})
        numbered = df.sparkSession.createDataFrame(rows, "position long, weights array<double>")
        tables.append(cut_lineage(d.table.join(numbered, "position").select("level", "position", "weights")))
    return WideModel(design, alphas, found[:, : design.n_core], tables, int(totals["n"]))


def _solve(training: DataFrame, design: WideDesign, alphas: np.ndarray, start: np.ndarray, n: int, tol: float, max_iter: int) -> np.ndarray:
    """Coefficients at every penalty; all penalties share every pass."""
    held = np.ones((len(alphas), design.size)) * alphas[:, None]
    held[:, 0] = 0.0
    best = np.tile(start, (len(alphas), 1))
    tried, lowest = best.copy(), np.full(len(alphas), np.inf)
    going = np.arange(len(alphas))
    for _ in range(max_iter):
        value, gradient, diagonal = _sums(training, design, tried[going], None)
        value = value / n + 0.5 * (held[going] * tried[going] ** 2).sum(axis=1)
        worse = ~(value <= lowest[going] + 1e-13 * np.abs(lowest[going])) & np.isfinite(lowest[going])
        back, rows = going[worse], going[~worse]
        tried[back] = (tried[back] + best[back]) / 2
        best[rows], lowest[rows] = tried[rows], value[~worse]
        if len(rows):
            slope = gradient[~worse] / n + held[rows] * best[rows]
            step = _conjugate_gradients(training, design, best[rows], slope, held[rows], diagonal[~worse] / n + held[rows], n)
            tried[rows] = best[rows] - step
            done = (slope * step).sum(axis=1) <= tol
            best[rows[done]] = tried[rows[done]]
            going = np.sort(np.concatenate([back, rows[~done]]))
        if not len(going):
            return best
    raise ValueError(f"{len(going)} of {len(alphas)} fits did not converge in {max_iter} steps")


def _conjugate_gradients(training: DataFrame, design: WideDesign, betas: np.ndarray, slope: np.ndarray, held: np.ndarray, diagonal: np.ndarray, n: int) -> np.ndarray:
    """Newton steps: the Hessians' systems, solved the more exactly the smaller the gradient is."""
    step, rest = np.zeros_like(slope), slope.copy()
    scaled = rest / diagonal
    direction = scaled.copy()
    size = (rest * scaled).sum(axis=1)
    goal = size * np.minimum(0.01, size)
    going = np.flatnonzero(size > 0)
    for _ in range(2 * design.size):
        if not len(going):
            break
        _, product, _ = _sums(training, design, betas[going], direction[going])
        product = product / n + held[going] * direction[going]
        length = size[going] / (direction[going] * product).sum(axis=1)
        step[going] += length[:, None] * direction[going]
        rest[going] -= length[:, None] * product
        scaled = rest[going] / diagonal[going]
        new = (rest[going] * scaled).sum(axis=1)
        direction[going] = scaled + (new / size[going])[:, None] * direction[going]
        size[going] = new
        going = going[new > np.maximum(goal[going], 1e-28)]
    return step


def _sums(training: DataFrame, design: WideDesign, betas: np.ndarray, directions: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian diagonal over all cells at each row of ``betas``; with ``directions`` the Hessians' products in place of the gradient."""
    k, size, n_core = len(betas), design.size, design.n_core
    kinds = 2 if directions is None else 1
    pad = np.zeros((1, k))
    context = training.sparkSession.sparkContext
    shared = context.broadcast((np.vstack([betas.T, pad]), None if directions is None else np.vstack([directions.T, pad])))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, v = shared.value
        value, blocks = np.zeros(k), {}

        def predictor(w: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
            return x @ w[:n_core] + w[at].sum(axis=1)

        core = np.zeros((n_core, kinds * k))
        for batch in batches:
            y_all, log_e = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x_all = batch.column(2).flatten().to_numpy().reshape(-1, n_core)
            at_all = batch.column(3).flatten().to_numpy().reshape(len(x_all), -1)
            for first in range(0, len(x_all), ROWS_AT_ONCE):
                cut = slice(first, first + ROWS_AT_ONCE)
                x, at, y = x_all[cut], at_all[cut], y_all[cut, None]
                eta = predictor(b, x, at) + log_e[cut, None]
                mu = np.exp(np.minimum(eta, 700.0))
                if v is None:
                    value += (mu - y * eta).sum(axis=0)
                    core += np.hstack([x.T @ (mu - y), (x * x).T @ mu])
                    terms = np.hstack([mu - y, mu])
                else:
                    terms = mu * predictor(v, x, at)
                    core += x.T @ terms
                for places in at.T:
                    order = np.argsort(places, kind="stable")
                    own, starts = np.unique(places[order], return_index=True)
                    sums = np.add.reduceat(terms[order], starts, axis=0)
                    for block in np.unique(own // BLOCK):
                        here = (own // BLOCK == block) & (own < size)
                        total = blocks.setdefault(int(block), np.zeros((BLOCK, kinds * k)))
                        total[own[here] % BLOCK] += sums[here]
        found = {-2: value, -1: core, **blocks}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([t.tobytes() for t in found.values()], pa.binary())], names=["block", "sums"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(part.as_py())
                totals[block] = totals[block] + own if block in totals else own
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["block", "sums"])

    parts = training.mapInArrow(add_up, "block int, sums binary")
    rows = parts.repartition("block").mapInArrow(join_up, "block int, sums binary").collect()
    shared.unpersist()
    value, flat = np.zeros(k), np.zeros((-(-(size + 1) // BLOCK) * BLOCK, kinds * k))
    core = np.zeros((n_core, kinds * k))
    for r in rows:
        own = np.frombuffer(bytes(r["sums"]))
        if r["block"] == -2:
            value = own
        elif r["block"] == -1:
            core = own.reshape(n_core, -1)
        else:
            flat[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = own.reshape(BLOCK, -1)
    flat[:n_core] += core
    out = flat[:size].T
    return value, out[:k], out[k:]
