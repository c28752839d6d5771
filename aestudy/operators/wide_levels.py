"""Newton steps for one wide category whose coefficients are a table.

The levels' coefficients, gradients and Hessian diagonals are columns of a table with one row per level, joined with
the cells that lie dealt by level. The levels' block of the Hessian is diagonal and is eliminated, so that a Newton
step is a small system of the core and one projection of the table. The driver holds the core's numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy.sources.checkpoints import cut_lineage

if TYPE_CHECKING:
    from aestudy.operators.wide import WideDesign

#: Cells in a task, and of one level before it is split.
CELLS_PER_TASK = 100_000
#: Sums that one pass makes for all its penalties together, about.
SUMS_PER_PASS = 200


def solve_by_level(merged: DataFrame, design: WideDesign, alphas: Sequence[float], start: float, n_cells: int, n: int, tol: float, max_iter: int) -> tuple[np.ndarray, DataFrame]:
    """The core's coefficients, one row per penalty, and ``(level, position, weights)`` of all levels.

    A level with more than ``CELLS_PER_TASK`` cells is split by a hash of the features.
    """
    cells = LevelCells(merged, design, n_cells, n)
    at_once = max(1, SUMS_PER_PASS // (design.n_core * (design.n_core + 5) // 2))
    core, names, levels = [], [], None
    try:
        for first in range(0, len(alphas), at_once):
            own, state = _solve(cells, np.array(alphas[first : first + at_once]), start, tol, max_iter)
            new = [f"w_{first + i}" for i in range(len(own))]
            found = cut_lineage(state.select("key", *[F.col(f"best_{i}").alias(name) for i, name in enumerate(new)]))
            cells.let_go()
            levels = found if levels is None else levels.join(found, "key", "full")
            names += new
            core.append(own)
    finally:
        cells.close()
    weights = F.array(*[F.coalesce(name, F.lit(0.0)) for name in names]).alias("weights")  # levels without cells: zero
    own = design.dictionaries[0].table.join(levels.withColumnRenamed("key", "position"), "position", "left")
    return np.concatenate(core), cut_lineage(own.select("level", "position", weights))


def core_columns(n_core: int) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"x_{j}") for j in range(1, n_core)]]


def _dot(weights: Sequence[float], columns: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for weight, column in zip(weights, columns):
        total = total + float(weight) * column
    return total


class LevelCells:
    """Cells dealt by their level's key, and the passes that sum over them."""

    def __init__(self, merged: DataFrame, design: WideDesign, n_cells: int, n: int) -> None:
        self.design, self.n = design, int(n)
        self.parts = 1 + n_cells // CELLS_PER_TASK
        features = [f"x_{j}" for j in range(1, design.n_core)]
        cells = cut_lineage(design.keyed(merged).select("key", "y", F.ln("e").alias("log_e"), *features, F.xxhash64(*design.variables).alias("salt")))
        counts = cells.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_TASK).alias("n_salts")).where("n_salts > 1")
        self.hot = cut_lineage(counts)  # at most one level per CELLS_PER_TASK cells
        self.salted = self.hot.count() > 0
        if self.salted:
            cells = cells.join(F.broadcast(self.hot), "key", "left").withColumn("salt", F.pmod("salt", F.coalesce("n_salts", F.lit(1))))
        self.keys = ["key", "salt"] if self.salted else ["key"]
        self.cells = cells.select("y", "log_e", *features, *self.keys).repartition(self.parts, *self.keys).sortWithinPartitions(*self.keys).persist()
        self.held: list[DataFrame] = []

    def hold(self, state: DataFrame) -> DataFrame:
        """Keep a state until it is let go; the one it is made from is needed until then."""
        self.held.append(state.persist())
        return state

    def let_go(self, keep: int = 0) -> None:
        while len(self.held) > keep:
            self.held.pop(0).unpersist()

    def close(self) -> None:
        self.let_go()
        self.cells.unpersist()

    def start(self, k: int) -> DataFrame:
        zeros = {f"{name}_{i}": F.lit(0.0) for i in range(k) for name in ("best", "tried")}
        return self.hold(self.design.levels().withColumns(zeros).repartition(self.parts, "key"))

    def beside(self, state: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Cells with columns of their level's state."""
        own = state.select("key", *columns)
        if self.salted:
            salts = F.sequence(F.lit(0).cast("long"), F.coalesce("n_salts", F.lit(1)) - 1)
            own = own.join(F.broadcast(self.hot), "key", "left").withColumn("salt", F.explode(salts)).drop("n_salts")
        return self.cells.join(own, self.keys)

    def predictors(self, state: DataFrame, column: str, core: np.ndarray, going: Sequence[int], extra: Sequence[str] = ()) -> DataFrame:
        """Cells with ``eta_i`` and ``mu_i`` of the open penalties."""
        rows = self.beside(state, [*[f"{column}_{i}" for i in going], *extra])
        x = core_columns(self.design.n_core)
        etas = {f"eta_{i}": F.col("log_e") + _dot(core[i], x) + F.col(f"{column}_{i}") for i in going}
        return rows.withColumns(etas).withColumns({f"mu_{i}": F.exp(F.least(F.col(f"eta_{i}"), F.lit(700.0))) for i in going})

    def by_level(self, rows: DataFrame, sums: dict[str, Column], carried: Sequence[str]) -> DataFrame:
        """Sums of columns over every level's cells, beside the level's own columns."""
        same = [F.max(c).alias(c) for c in carried]
        found = rows.groupBy(*self.keys).agg(*same, *[F.sum(c).alias(name) for name, c in sums.items()])
        if self.salted:
            found = found.groupBy("key").agg(*same, *[F.sum(name).alias(name) for name in sums])
        return found

    def core_sums(self, rows: DataFrame, going: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient and Hessian of the core at every open penalty."""
        p, k = self.design.n_core, len(going)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((k, 1 + p + p * p))
            for batch in batches:
                columns = [c.to_numpy() for c in batch.columns]
                y, x = columns[0], np.column_stack([np.ones(batch.num_rows), *columns[1:p]])
                for total, eta, mu in zip(totals, columns[p : p + k], columns[p + k :]):
                    total[0] += (mu - y * eta).sum()
                    total[1 : 1 + p] += x.T @ (mu - y)
                    total[1 + p :] += ((x.T * mu) @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(totals.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

        def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found[i] = found.get(i, 0.0) + np.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([s.tolist() for s in found.values()], pa.list_(pa.float64()))], names=["i", "sums"])

        wanted = rows.select("y", *[f"x_{j}" for j in range(1, p)], *[f"eta_{i}" for i in going], *[f"mu_{i}" for i in going])
        parts = wanted.mapInArrow(add_up, "i int, sums array<double>").repartition("i").mapInArrow(join_up, "i int, sums array<double>")
        sums = np.array([r["sums"] for r in sorted(parts.collect(), key=lambda r: r["i"])])
        return sums[:, 0], sums[:, 1 : 1 + p], sums[:, 1 + p :].reshape(k, p, p)


def _sums_of(state: DataFrame, sums: dict[str, Column]) -> dict[str, float]:
    """Sums over the free levels."""
    row = state.where("free = 1").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).first()
    return {name: row[name] or 0.0 for name in sums}


def _solve(cells: LevelCells, alphas: np.ndarray, start: float, tol: float, max_iter: int) -> tuple[np.ndarray, DataFrame]:
    """Core coefficients at every penalty and the levels' as ``best_i``; all penalties share every pass."""
    k, p, n = len(alphas), cells.design.n_core, cells.n
    pull = np.ones((k, p)) * alphas[:, None]
    pull[:, 0] = 0.0
    best = np.zeros((k, p))
    best[:, 0] = start
    tried, lowest, state = best.copy(), np.full(k, np.inf), cells.start(k)
    going = np.arange(k)
    for _ in range(max_iter):
        rows = cells.predictors(state, "tried", tried, going)
        value, gradient, hessian = cells.core_sums(rows, going)
        squares = _sums_of(state, {str(i): F.col(f"tried_{i}") ** 2 for i in going})
        held = (pull[going] * tried[going] ** 2).sum(axis=1) + alphas[going] * np.array([squares[str(i)] for i in going])
        value = value / n + 0.5 * held
        worse = ~(value <= lowest[going] + 1e-13 * np.abs(lowest[going])) & np.isfinite(lowest[going])
        back, open_now = going[worse], going[~worse]
        halved = {f"tried_{i}": (F.col(f"tried_{i}") + F.col(f"best_{i}")) / 2 for i in back}
        state = state.withColumns(halved | {f"best_{i}": F.col(f"tried_{i}") for i in open_now})
        tried[back] = (tried[back] + best[back]) / 2
        best[open_now], lowest[open_now] = tried[open_now], value[~worse]
        if len(open_now):
            slope = gradient[~worse] / n + pull[open_now] * best[open_now]
            curved = hessian[~worse] / n
            step, fall, state = _step(cells, state, alphas, best, slope, curved, pull, open_now)
            tried[open_now] = best[open_now] - step
            state = state.withColumns({f"tried_{i}": F.col(f"best_{i}") - F.col(f"step_{i}") for i in open_now})
            done = open_now[fall <= tol]
            best[done] = tried[done]
            state = state.withColumns({f"best_{i}": F.col(f"tried_{i}") for i in done})
            state = state.select("key", "free", *[f"{name}_{i}" for i in range(k) for name in ("best", "tried")])
            going = np.sort(np.concatenate([back, open_now[fall > tol]]))
        if not len(going):
            return best, state
    raise ValueError(f"{len(going)} of {k} fits did not converge in {max_iter} steps")


def _step(cells: LevelCells, state: DataFrame, alphas: np.ndarray, best: np.ndarray, slope: np.ndarray, curved: np.ndarray, pull: np.ndarray, going: np.ndarray) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Newton steps: the levels' diagonal block is eliminated, what is left is a system of the core."""
    p, n = cells.design.n_core, cells.n
    x = core_columns(p)
    carried = [c for c in state.columns if c != "key"]
    rows = cells.predictors(state, "best", best, going, [c for c in carried if c not in {f"best_{i}" for i in going}])
    sums = {}
    for i in going:
        sums[f"r_{i}"] = F.col(f"mu_{i}") - F.col("y")
        sums |= {f"c_{i}_{j}": F.col(f"mu_{i}") * x[j] for j in range(p)}  # with the intercept: the diagonal
    state = cells.hold(cells.by_level(rows, sums, carried))  # levels without cells stay at zero
    wanted = {}
    for i in going:
        own, diagonal = F.col(f"r_{i}") / n + float(alphas[i]) * F.col(f"best_{i}"), F.col(f"c_{i}_0") / n + float(alphas[i])
        wanted[f"fall_{i}"] = own * own / diagonal
        for j in range(p):
            cross = F.col(f"c_{i}_{j}") / n / diagonal
            wanted[f"right_{i}_{j}"] = cross * own
            wanted |= {f"left_{i}_{j}_{m}": cross * F.col(f"c_{i}_{m}") / n for m in range(j, p)}
    found = _sums_of(state, wanted)
    cells.let_go(keep=1)
    steps, falls, columns = [], [], {}
    for at, i in enumerate(going):
        left = np.array([[found[f"left_{i}_{min(j, m)}_{max(j, m)}"] for m in range(p)] for j in range(p)])
        right = np.array([found[f"right_{i}_{j}"] for j in range(p)])
        step = np.linalg.solve(curved[at] + np.diag(pull[i]) - left, slope[at] - right)
        steps.append(step)
        falls.append(slope[at] @ step + found[f"fall_{i}"] - right @ step)
        own, diagonal = F.col(f"r_{i}") / n + float(alphas[i]) * F.col(f"best_{i}"), F.col(f"c_{i}_0") / n + float(alphas[i])
        columns[f"step_{i}"] = F.col("free") * (own - _dot(step / n, [F.col(f"c_{i}_{j}") for j in range(p)])) / diagonal
    return np.array(steps), np.array(falls), state.withColumns(columns)
