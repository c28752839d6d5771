"""Poisson gradient boosting with an exposure offset, early stopping and prediction.

Training works on cells: counts and exposures of rows with equal encoded features add up, and a
cell's fitted mean is its exposure times ``exp`` of its margin. The cells are checkpointed once; trees grow
from histograms that passes over them add up (see ``histogram``).
"""

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.functions import text
from aestudy.functions.poisson import usable_counts
from aestudy.operators.checks import require_columns
from aestudy.operators.encode import EncodedColumn, encode
from aestudy.operators.histogram import TreeGrower, block_cells, feature_layout, persist_blocks, with_margins
from aestudy.operators.splits import Features, SplitRules, number_value
from aestudy.operators.tree import CELLS_PER_TASK, NODE_FIELDS, NODE_SCHEMA, Node, Tree
from aestudy.sources.checkpoints import cut_lineage

# Parameters of the boosted study model.
LEARNING_RATE = 0.01
GAMMA = 1.0
MAX_DEPTH = 3
MAX_ROUNDS = 1000
PATIENCE = 10
MAX_BINS = 256

#: Rounds after which margins are worked out anew and, with a state folder, trees are committed.
BLOCK = 25


@dataclass
class BoostModel:
    encoding: list[EncodedColumn]
    trees: list[Tree]
    best_iteration: int
    history: list[float] = field(default_factory=list)

    @property
    def input_cols(self) -> list[str]:
        return list(dict.fromkeys(e.source for e in self.encoding))

    def used_trees(self, iterations: int | None = None) -> list[Tree]:
        """Trees up to and with the best iteration, or the first ``iterations``."""
        return self.trees[: self.best_iteration + 1 if iterations is None else iterations]

    def predict(
        self,
        df: DataFrame,
        exposure: str | None = None,
        output: str = C.PREDICTION,
        iterations: int | None = None,
    ) -> DataFrame:
        """Add the fitted mean, or without ``exposure`` the multiplier of expected.

        Trees are walked in Arrow batches, all rows of a batch at once, however many trees there are.
        """
        require_columns(df.columns, self.input_cols)
        names = [e.name for e in self.encoding]
        kept = [c for c in df.columns if c != output]
        mean = F.exp(ensemble_udf(self.used_trees(iterations), names)(F.struct(*[e.value().alias(e.name) for e in self.encoding])))
        if exposure is not None:
            mean = mean * F.col(exposure)
        return df.select(*kept, mean.alias(output))


def ensemble_udf(trees: Sequence[Tree], names: Sequence[str]):
    """Vectorised walk of an ensemble over a struct of encoded features."""
    flat = [_flatten(t, list(names)) for t in trees]

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            x = rows.to_numpy(dtype="float64", na_value=np.nan)
            total = np.zeros(len(x))
            for feature, threshold, yes, no, missing, leaf, depth in flat:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    value = x[np.arange(len(x)), feature[at]]
                    down = np.where(value < threshold[at], yes[at], no[at])
                    at = np.where(np.isnan(value), missing[at], down)
                total += leaf[at]
            yield pd.Series(total)

    return F.pandas_udf(margins, "double")


def _flatten(tree: Tree, names: list[str]) -> tuple:
    """A tree as arrays by node id; a leaf leads to itself."""
    nodes = sorted(tree.nodes, key=lambda n: n.nodeid)
    place = {n.nodeid: i for i, n in enumerate(nodes)}

    def targets(get) -> np.ndarray:
        return np.array([place[get(n)] if n.is_split else i for i, n in enumerate(nodes)])

    return (
        np.array([names.index(n.source) if n.is_split else 0 for n in nodes]),
        np.array([n.threshold if n.is_split else 0.0 for n in nodes]),
        targets(lambda n: n.yes),
        targets(lambda n: n.no),
        targets(lambda n: n.missing),
        np.array([0.0 if n.is_split else n.leaf for n in nodes]),
        max(n.depth for n in nodes),
    )


def bin_cuts(df: DataFrame, names: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Lower ends of the bins of columns with more than ``max_bins`` distinct values.

    Distinct values are counted exactly, and bins hold equal shares of the rows. Running counts come
    from sorted partitions and the partitions' totals, so no task holds all values of a column; how
    the values are partitioned does not change the cuts.
    """
    values = F.array(*[F.struct(F.lit(i).alias("i"), number_value(n).alias("v")) for i, n in enumerate(names)])
    counted = df.select(F.inline(values)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = cut_lineage(counted.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("i", "part").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    by_part, column = Window.partitionBy("i").orderBy("part"), Window.partitionBy("i")
    before = F.coalesce(F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("i", "part", before.alias("before"), F.sum("rows").over(column).alias("all_rows"), F.sum("values").over(column).alias("all_values"))
    inside = Window.partitionBy("i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    wide = ordered.join(sizes.where(F.col("all_values") > max_bins), ["i", "part"])
    place = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    bins = wide.select("i", "v", F.floor(place * max_bins / F.col("all_rows")).alias("bin")).groupBy("i", "bin").agg(F.min("v").alias("v"))
    cuts: dict[str, list[float]] = {}
    for row in bins.orderBy("i", "v").collect():
        cuts.setdefault(names[row["i"]], []).append(row["v"])
    return cuts


def binned(x: str, cuts: Sequence[float]) -> str:
    """Lower end of the bin that holds the value, as SQL text: a balanced tree of comparisons."""
    if len(cuts) == 1:
        return text.number(cuts[0])
    middle = len(cuts) // 2
    return f"CASE WHEN {x} < {text.number(cuts[middle])} THEN {binned(x, cuts[:middle])} ELSE {binned(x, cuts[middle:])} END"


def boost_cells(
    train: DataFrame,
    valid: DataFrame | None,
    encoding: Sequence[EncodedColumn],
    actual: str,
    expected: str,
    max_bins: int,
) -> tuple[DataFrame, Features]:
    """Encoded and binned cells ``(valid flag, features, y, e, n, bad)`` of both data sets."""
    names = [e.name for e in encoding]
    rows = encode(train, encoding, [actual, expected]).withColumn("__valid", F.lit(False))
    cuts = bin_cuts(rows, names, max_bins)
    if valid is not None:
        rows = rows.unionByName(encode(valid, encoding, [actual, expected]).withColumn("__valid", F.lit(True)))
    if cuts:
        rows = rows.withColumns({n: number_value(n) for n in cuts})
        rows = rows.withColumns({n: F.expr(f"CASE WHEN {text.name(n)} IS NOT NULL THEN {binned(text.name(n), c)} END") for n, c in cuts.items()})
    y, e = F.col(actual).cast("double"), F.col(expected).cast("double")
    fine = usable_counts(y, e)
    cells = rows.groupBy("__valid", *names).agg(
        F.sum(y).alias("__y"), F.sum(e).alias("__e"), F.count(F.lit(1)).alias("__n"), F.count_if(~fine).alias("__bad")
    )
    return cells, Features(numbers=names, strings=[], binned=list(cuts))


def fit_boost(
    train: DataFrame,
    valid: DataFrame | None,
    encoding: Sequence[EncodedColumn],
    actual: str = C.ACTUAL,
    expected: str = C.EXPECTED,
    learning_rate: float = LEARNING_RATE,
    rules: SplitRules = SplitRules(gamma=GAMMA),
    max_depth: int = MAX_DEPTH,
    max_rounds: int = MAX_ROUNDS,
    patience: int = PATIENCE,
    max_bins: int = MAX_BINS,
    block: int = BLOCK,
    state: str | None = None,
) -> BoostModel:
    """Boost Poisson trees until the validation loss has not improved for ``patience`` rounds.

    The pass that begins a round also sums the loss of the trees before it, so a fit stops at once. The
    loss is the mean Poisson negative log-likelihood without the terms that no model can change.
    ``gamma`` is compared with the full gain, without a factor of one half.

    After every ``block`` rounds, margins are worked out anew from the cells and all trees, so lineage
    stays short. With a folder ``state``, the block's trees are committed to it then; a fit
    that is started again on that folder goes on after the last committed block, to the same model.
    """
    cells, features = boost_cells(train, valid, encoding, actual, expected, max_bins)
    cells = cut_lineage(cells)
    totals = cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.when(F.col("__valid"), F.col("__n"))).alias("n_valid"),
        F.sum(F.when(~F.col("__valid"), F.col("__n"))).alias("n_train"),
        F.sum("__bad").alias("bad"),
        F.sum("__y").alias("y"),
        F.sum("__e").alias("e"),
    ).first()
    if not totals["n_train"]:
        raise ValueError("there are no training rows")
    if totals["bad"]:
        raise ValueError(f"{totals['bad']} rows lack an actual or have a non-positive expected count")
    n_valid = totals["n_valid"] or 0
    layout = feature_layout(cells, features)
    base = persist_blocks(block_cells(cells.coalesce(1 + totals["n_cells"] // CELLS_PER_TASK), layout))
    names = layout.names
    grower = TreeGrower(layout, rules, max_depth, learning_rate)
    trees: list[Tree] = []
    history: list[float] = []
    log = None
    if state is not None:
        # Sums are rounded, since the order in which they are added may differ.
        run = [names, learning_rate, repr(rules), max_depth, max_bins, totals["n_train"], n_valid, f"{totals['y']:.9g}", f"{totals['e']:.9g}"]
        log = BoostLog(train.sparkSession, state, run)
        trees, history = log.committed()
    flat = [_flatten(t, names) for t in trees]
    begun, current = 0, base
    try:
        while True:
            if current is base or len(flat) - begun >= block:
                if current is not base:
                    current.unpersist()
                begun = len(flat)
                current = persist_blocks(with_margins(base, flat)) if flat else base
            known: dict = {}
            loss = grower.sums(current, flat[begun:], known, {}) if n_valid or len(trees) < max_rounds else None
            if n_valid and len(history) < len(trees):
                history.append(loss / n_valid)
                stop = _stopping_round(history, patience)
                if stop is not None:
                    trees, history = trees[: stop + 1], history[: stop + 1]
                    break
            if log is not None and len(trees) - log.rounds >= block:
                log.commit(trees, history)
            if len(trees) >= max_rounds:
                break
            trees.append(grower.grow(current, flat[begun:], known))
            flat.append(_flatten(trees[-1], names))
    finally:
        current.unpersist()
        base.unpersist()
    best = int(np.argmin(history)) if history else len(trees) - 1
    return BoostModel(list(encoding), trees, best, history)


class BoostLog:
    """Committed rounds of a fit: a table of tree nodes and one of blocks, whose row is written last."""

    def __init__(self, spark: SparkSession, path: str, run: list) -> None:
        self.spark, self.path, self.run = spark, path, json.dumps(run)
        self.rounds = 0

    def committed(self) -> tuple[list[Tree], list[float]]:
        """Trees and losses of all committed blocks; a block whose row is missing was not finished."""
        try:
            rows = self.spark.read.schema("block string, first int, last int, history array<double>, run string").parquet(f"{self.path}/blocks").orderBy("first").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return [], []
        if any(r["run"] != self.run for r in rows):
            raise ValueError(f"{self.path} holds another fit: its settings or its data differ")
        nodes = self.spark.read.schema(f"block string, tree int, {NODE_SCHEMA}").parquet(f"{self.path}/nodes")
        trees: dict[int, list[Node]] = {}
        for r in nodes.where(F.col("block").isin([r["block"] for r in rows])).orderBy("tree", "nodeid").collect():
            fields = r.asDict()
            fields.pop("block")
            trees.setdefault(fields.pop("tree"), []).append(Node(**fields))
        self.rounds = len(trees)
        return [Tree(trees[i]) for i in sorted(trees)], [loss for r in rows for loss in r["history"]]

    def commit(self, trees: Sequence[Tree], history: Sequence[float]) -> None:
        block = uuid.uuid4().hex
        rows = [(block, i, *(getattr(n, f) for f in NODE_FIELDS)) for i in range(self.rounds, len(trees)) for n in trees[i].nodes]
        self.spark.createDataFrame(rows, f"block string, tree int, {NODE_SCHEMA}").coalesce(1).write.mode("append").parquet(f"{self.path}/nodes")
        row = (block, self.rounds, len(trees), [float(v) for v in history[self.rounds : len(trees)]], self.run)
        self.spark.createDataFrame([row], "block string, first int, last int, history array<double>, run string").coalesce(1).write.mode("append").parquet(f"{self.path}/blocks")
        self.rounds = len(trees)


def _stopping_round(history: Sequence[float], patience: int) -> int | None:
    """First round at which the best loss is ``patience`` rounds old, if there is one."""
    best = 0
    for i, loss in enumerate(history):
        if loss < history[best]:
            best = i
        if i - best >= patience:
            return i
    return None
