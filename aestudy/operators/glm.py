"""Poisson regression with a log-exposure offset over a ridge path.

Counts and exposures of rows with equal features add without changing the likelihood of the
coefficients, so the solver runs on one row per distinct feature combination, however many rows or
cells the study has. Row-level sums that the merge would lose (row count, ``y ln y`` terms) are
added up in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.functions import text
from aestudy.functions.poisson import fail_unless, usable_counts, y_log_ratio
from aestudy.operators.checks import require_columns
from aestudy.operators.deviance import null_deviance
from aestudy.operators.design import Design, DesignColumn

INTERCEPT = "intercept"

# Penalty path of the ridge search.
ALPHA_MAX = 10.0
MIN_ALPHA_RATIO = 1e-6
N_ALPHAS = 100

CELLS_PER_TASK = 2_000
#: Cells whose outer products are held at once, and numbers that a pass sums for all its penalties.
CELLS_AT_ONCE = 512
SUMS_PER_PASS = 4_000_000
MAX_COLUMNS = 4096


def penalty_path(
    n_alphas: int = N_ALPHAS, alpha_max: float = ALPHA_MAX, min_ratio: float = MIN_ALPHA_RATIO
) -> list[float]:
    """Penalties from the largest to the smallest, evenly spaced in logarithm."""
    if n_alphas == 1:
        return [alpha_max]
    return [float(a) for a in np.geomspace(alpha_max, alpha_max * min_ratio, n_alphas)]


@dataclass
class GLMPath:
    """Coefficients along a penalty path, and the design that encodes their columns."""

    design: Design
    alphas: list[float]
    intercepts: list[float]
    coefficients: list[list[float]]
    n_rows: int = 0
    n_dropped: int = 0

    @property
    def input_cols(self) -> list[str]:
        return self.design.variables

    def index(self, alpha_index: int) -> int:
        return range(len(self.alphas))[alpha_index]

    def by_name(self, alpha_index: int = -1) -> dict[str, float]:
        """Intercept first, then one coefficient per design column."""
        i = self.index(alpha_index)
        named = {INTERCEPT: float(self.intercepts[i])}
        named.update(zip(self.design.column_names, (float(c) for c in self.coefficients[i])))
        return named

    def coefficient_table(self, spark: SparkSession, alpha_index: int | None = None) -> DataFrame:
        """``(alpha_index, pos, term, term_value)`` at one penalty or along the path."""
        wanted = range(len(self.alphas)) if alpha_index is None else [self.index(alpha_index)]
        rows = [(i, pos, t, v) for i in wanted for pos, (t, v) in enumerate(self.by_name(i).items())]
        return spark.createDataFrame(rows, "alpha_index int, pos int, term string, term_value double")

    def predict(
        self,
        df: DataFrame,
        alpha_index: int = -1,
        exposure: str | None = None,
        output: str = C.PREDICTION,
        columns: Sequence[DesignColumn] | None = None,
    ) -> DataFrame:
        """Add the fitted mean, or without ``exposure`` the multiplier of expected."""
        require_columns(df.columns, self.input_cols)
        named = self.by_name(alpha_index)
        score = F.lit(named[INTERCEPT]) + self.design.linear_predictor(named, columns)
        mean = F.exp(score)
        if exposure is not None:
            mean = mean * F.col(exposure)
        kept = [c for c in df.columns if c != output]
        return self.design.with_basis(df, columns).select(*kept, mean.alias(output))

    def path_stats(self, df: DataFrame, actual: str = C.ACTUAL, expected: str = C.EXPECTED) -> DataFrame:
        """``(alpha_index, d2)``: share of the Poisson null deviance explained at every penalty."""
        sums = self._path_sums(df, actual, expected)
        null = null_deviance(F.col("n"), F.col("y"), F.col("yly"))
        score = F.when(F.col("n") >= 2, F.lit(1.0) - F.try_divide(_checked(F.col("dev")), null))
        return sums.select("alpha_index", score.alias("d2"))

    def path_totals(self, df: DataFrame, actual: str = C.ACTUAL, expected: str = C.EXPECTED) -> DataFrame:
        """``(alpha_index, actual, predicted)`` over the rows that have all features."""
        sums = self._path_sums(df, actual, expected)
        return sums.select("alpha_index", F.col("y").alias("actual"), _checked(F.col("mean")).alias("predicted"))

    def path_scores(self, df: DataFrame, actual: str = C.ACTUAL, expected: str = C.EXPECTED) -> DataFrame:
        """``(alpha_index, pos, score)``: the objective's derivative by every coefficient, zero at a fit."""
        scored, names = self._scored_cells(df, actual, expected)
        residual = "(e * exp(eta) - y)"
        sums = ", ".join([f"sum({residual})", *[f"sum({residual} * {x})" for x in names]])
        rows = scored.groupBy("alpha_index").agg(F.sum("n").alias("n"), F.expr(f"array({sums})").alias("s"))
        held = [(i, pos, a * w) for i, a in enumerate(self.alphas) for pos, w in enumerate([0.0, *self.coefficients[i]])]
        pull = df.sparkSession.createDataFrame(held, "alpha_index int, pos int, pull double")
        rows = rows.select("alpha_index", "n", F.posexplode("s").alias("pos", "s")).join(pull, ["alpha_index", "pos"])
        return rows.select("alpha_index", "pos", (F.col("s") / F.col("n") + F.col("pull")).alias("score"))

    def _scored_cells(self, df: DataFrame, actual: str, expected: str) -> tuple[DataFrame, list[str]]:
        """The merged cells with their features (their names beside) and the predictor at every penalty."""
        merged = merge_cells(df, self.design, actual, expected)
        table = [[float(b), *map(float, w)] for b, w in zip(self.intercepts, self.coefficients)]
        names = [f"x{i}" for i in range(len(self.design.columns))]
        features = [self.design.feature(c).alias(x) for x, c in zip(names, self.design.columns)]
        sums = ["y", "e", "n", "n_bad", "y_log_rate", "y_log_y"]
        weights = "array(" + ", ".join(text.numbers(row) for row in table) + ")"
        dot = " + ".join(["w[0]", *[f"w[{i + 1}] * {x}" for i, x in enumerate(names)]])
        scored = (
            self.design.with_basis(merged)
            .select(*sums, *features)
            .selectExpr("*", f"posexplode({weights}) AS (alpha_index, w)")
            .selectExpr("alpha_index", *sums, *names, f"{dot} AS eta")
        )
        return scored, names

    def _path_sums(self, df: DataFrame, actual: str, expected: str) -> DataFrame:
        """Sums per penalty; one job over the merged feature combinations scores them all."""
        scored, _ = self._scored_cells(df, actual, expected)
        return scored.groupBy("alpha_index").agg(
            F.sum("n").alias("n"),
            F.sum("y").alias("y"),
            F.sum("y_log_y").alias("yly"),
            F.sum("n_bad").alias("n_bad"),
            F.expr("sum(e * exp(eta))").alias("mean"),
            F.expr("2D * sum(y_log_rate - y * eta - y + e * exp(eta))").alias("dev"),
        )


def _checked(value: Column) -> Column:
    return fail_unless(F.col("n_bad") == 0, "rows lack an actual or a positive expected count", value)


def best_alpha(path_stats: DataFrame) -> int:
    """Index with the highest explained deviance, the smaller index on ties."""
    best = path_stats.agg(F.min_by("alpha_index", F.struct(-F.col("d2"), F.col("alpha_index"))).alias("i"))
    return int(best.first()["i"])


def merge_cells(
    df: DataFrame, design: Design, actual: str, expected: str, keep_null: bool = False
) -> DataFrame:
    """One row per distinct feature combination, with the sums that the likelihood needs.

    ``y_log_rate`` is the sum of ``y ln(y/e)`` and ``y_log_y`` that of ``y ln y`` over the rows
    given. Rows with a NULL feature are left out unless they are asked for.
    """
    y, e = F.col(actual).cast("double"), F.col(expected).cast("double")
    rows = df if keep_null else df.dropna(how="any", subset=design.variables)
    return (
        rows.groupBy(*design.variables)
        .agg(
            F.sum(y).alias("y"),
            F.sum(e).alias("e"),
            F.count(F.lit(1)).alias("n"),
            F.sum(y_log_ratio(y, e)).alias("y_log_rate"),
            F.sum(y_log_ratio(y, F.lit(1.0))).alias("y_log_y"),
            F.count_if(~usable_counts(y, e)).alias("n_bad"),
        )
    )


def fit_glm_path(
    df: DataFrame,
    design: Design,
    alphas: Sequence[float] | None = None,
    actual: str = C.ACTUAL,
    expected: str = C.EXPECTED,
    tol: float = 1e-14,
    max_iter: int = 100,
) -> GLMPath:
    """Fit one regression per penalty.

    The objective is ``deviance / (2 n) + alpha / 2 |b|^2`` with ``n`` the number of rows of ``df``
    and a free intercept. All penalties take their Newton steps together: one pass over the cells
    sums gradients and Hessians for every open penalty, so the number of jobs does not grow with the
    path. A step that does not lower the objective is halved. A fit ends with the step whose squared
    Newton decrement is at most ``tol``; convergence is quadratic, so what it leaves over is rounding.
    """
    require_columns(df.columns, [*design.variables, actual, expected])
    if len(design.columns) >= MAX_COLUMNS:
        raise ValueError(f"the design has {len(design.columns)} columns, the solver takes fewer than {MAX_COLUMNS}")
    alphas = penalty_path() if alphas is None else [float(a) for a in alphas]
    merged = merge_cells(df, design, actual, expected, keep_null=True).persist()
    complete = F.lit(True)
    for v in design.variables:
        complete = complete & F.col(v).isNotNull()
    training = None
    try:
        totals = merged.agg(
            F.sum("n").alias("n_all"),
            F.count_if(complete).alias("n_cells"),
            F.sum(F.when(complete, F.col("n"))).alias("n"),
            F.sum(F.when(complete, F.col("y"))).alias("y"),
            F.sum(F.when(complete, F.col("e"))).alias("e"),
            F.sum(F.when(complete, F.col("n_bad"))).alias("n_bad"),
        ).first()
        if not totals["n"]:
            raise ValueError("there are no rows to fit a regression to")
        if totals["n_bad"]:
            raise ValueError(f"{totals['n_bad']} rows lack an actual or have a non-positive expected count")
        if not totals["y"] > 0:
            raise ValueError("the actual counts sum to zero")
        usable = merged.filter(complete).repartition(1 + totals["n_cells"] // CELLS_PER_TASK)
        features = [design.feature(c).cast("double") for c in design.columns]
        training = design.with_basis(usable).select("y", F.ln("e").alias("log_e"), F.array(F.lit(1.0), *features).alias("x")).persist()
        start = np.zeros(len(features) + 1)
        start[0] = np.log(totals["y"] / totals["e"])
        at_once = max(1, SUMS_PER_PASS // (len(start) + 1) ** 2)
        fits = []
        for first in range(0, len(alphas), at_once):
            fits += _newton_path(training, np.array(alphas[first : first + at_once]), start, totals["n"], tol, max_iter)
    finally:
        if training is not None:
            training.unpersist()
        merged.unpersist()
    return GLMPath(
        design=design,
        alphas=alphas,
        intercepts=[float(b[0]) for b in fits],
        coefficients=[[float(c) for c in b[1:]] for b in fits],
        n_rows=int(totals["n"]),
        n_dropped=int(totals["n_all"] - totals["n"]),
    )


def _newton_path(training: DataFrame, alphas: np.ndarray, start: np.ndarray, n: int, tol: float, max_iter: int) -> list[np.ndarray]:
    """Coefficients, intercept first, at every penalty."""
    size = len(start)
    held = np.ones(size)
    held[0] = 0.0
    tried = np.tile(start, (len(alphas), 1))
    best = tried.copy()
    lowest = np.full(len(alphas), np.inf)
    open_fits = list(range(len(alphas)))
    for _ in range(max_iter):
        if not open_fits:
            return list(best)
        sums = _newton_sums(training, tried[open_fits])
        going = []
        for i, own in zip(open_fits, sums):
            b, penalty = tried[i], alphas[i] * held
            value = own[0] / n + 0.5 * float(penalty @ (b * b))
            if not value <= lowest[i] + 1e-13 * abs(lowest[i]) and np.isfinite(lowest[i]):
                tried[i] = (b + best[i]) / 2
                going.append(i)
                continue
            best[i], lowest[i] = b.copy(), value
            gradient = own[1 : 1 + size] / n + penalty * b
            hessian = own[1 + size :].reshape(size, size) / n + np.diag(penalty)
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-15)[0]
            tried[i] = b - step
            if float(gradient @ step) <= tol:
                best[i] = tried[i]
            else:
                going.append(i)
        open_fits = going
    raise ValueError(f"{len(open_fits)} of {len(alphas)} fits did not converge in {max_iter} passes")


def _newton_sums(training: DataFrame, betas: np.ndarray) -> list[np.ndarray]:
    """Objective, gradient and Hessian over all cells, flat in one array, for each row of ``betas``.

    Tasks add up their own cells; their sums are added as they stream into one task per penalty.
    """
    k, size = betas.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + size + size * size))
        for batch in batches:
            y_all, log_e = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = batch.column(2).flatten().to_numpy().reshape(-1, size)
            for at in range(0, len(rows), CELLS_AT_ONCE):
                x, y = rows[at : at + CELLS_AT_ONCE], y_all[at : at + CELLS_AT_ONCE, None]
                eta = x @ betas.T + log_e[at : at + CELLS_AT_ONCE, None]
                mu = np.exp(np.minimum(eta, 700.0))
                total[:, 0] += (mu - y * eta).sum(axis=0)
                total[:, 1 : 1 + size] += (mu - y).T @ x
                total[:, 1 + size :] += mu.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], names=["i", "sums"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(part.as_py())
                totals[i] = totals[i] + own if i in totals else own
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["i", "sums"])

    parts = training.mapInArrow(add_up, "i int, sums binary")
    rows = parts.repartition("i").mapInArrow(join_up, "i int, sums binary").collect()
    found = {r["i"]: np.frombuffer(bytes(r["sums"])) for r in rows}
    return [found[i] for i in range(k)]
