"""Poisson regression trees on actual and exposure, their split statistics and report rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from math import exp

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from aestudy.functions import text
from aestudy.functions.poisson import group_deviance, usable_counts, y_log_ratio
from aestudy.operators.checks import require_columns
from aestudy.operators.splits import (
    Features,
    SplitRules,
    best_splits,
    describe_features,
    split_candidates,
    split_feature_name,
    value_sums,
)

ROOT_PATH = "ROOT"
PATH_AND = " AND "

# Depth and learning rate of the residual tree.
TREE_DEPTH = 3
TREE_ETA = 0.3

CELLS_PER_TASK = 50_000

NODE_SCHEMA = (
    "nodeid int, depth int, feature string, threshold double, yes int, no int, missing int, "
    "gain double, cover double, leaf double, source string, is_level boolean, level string"
)

NODE_FIELDS = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

# Columns of the split-statistics table, in order.
SPLIT_COLUMNS = [
    "nodeid",
    "split_label",
    "path_pretty",
    "left_path_pretty",
    "right_path_pretty",
    "feature",
    "threshold",
    "n_parent",
    "sum_y_parent",
    "sum_exp_parent",
    "ae_parent",
    "dev_parent",
    "n_left",
    "sum_y_left",
    "sum_exp_left",
    "ae_left",
    "dev_left",
    "n_right",
    "sum_y_right",
    "sum_exp_right",
    "ae_right",
    "dev_right",
    "dev_children",
    "dev_reduction",
    "xgb_gain",
    "xgb_cover",
]


@dataclass(frozen=True)
class Node:
    """A split, or a leaf when ``feature`` is None.

    ``feature`` is the encoded name (``Sex_F`` for a level); ``source`` the column it is read from.
    """

    nodeid: int
    depth: int
    feature: str | None = None
    threshold: float | None = None
    yes: int | None = None
    no: int | None = None
    missing: int | None = None
    gain: float | None = None
    cover: float | None = None
    leaf: float | None = None
    source: str | None = None
    is_level: bool = False
    level: str | None = None

    @property
    def is_split(self) -> bool:
        return self.feature is not None

    def goes_left(self) -> str:
        """Condition for the ``yes`` side as SQL text; a missing number follows ``missing``."""
        column = text.name(self.source or self.feature)
        if self.is_level:
            return f"CAST({column} <=> {text.string(self.level)} AS DOUBLE) < {text.number(self.threshold)}"
        x = f"nanvl(CAST({column} AS DOUBLE), CAST(NULL AS DOUBLE))"
        below = f"{x} < {text.number(self.threshold)}"
        return f"({below} OR {x} IS NULL)" if self.missing == self.yes else below


@dataclass
class Tree:
    nodes: list[Node]

    def __post_init__(self) -> None:
        self.by_id = {n.nodeid: n for n in self.nodes}

    @property
    def splits(self) -> list[Node]:
        return [n for n in self.nodes if n.is_split]

    @property
    def leaves(self) -> list[Node]:
        return [n for n in self.nodes if not n.is_split]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.nodeid, n.depth, n.feature, n.threshold, n.yes, n.no, n.missing, n.gain, n.cover, n.leaf, n.source, n.is_level, n.level)
            for n in self.nodes
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @classmethod
    def from_frame(cls, nodes: DataFrame) -> Tree:
        return cls([Node(**r.asDict()) for r in nodes.orderBy("nodeid").collect()])

    def route_text(self) -> str:
        """Id of the leaf a row falls into, as SQL text."""
        return self._fold(lambda leaf: str(leaf.nodeid))

    def route(self) -> Column:
        return F.expr(self.route_text())

    def leaf_value(self) -> Column:
        return F.expr(self._fold(lambda leaf: text.number(leaf.leaf)))

    def _fold(self, at_leaf: Callable[[Node], str], nodeid: int = 0) -> str:
        node = self.by_id[nodeid]
        if not node.is_split:
            return at_leaf(node)
        yes, no = self._fold(at_leaf, node.yes), self._fold(at_leaf, node.no)
        return f"CASE WHEN {node.goes_left()} THEN {yes} ELSE {no} END"

    def paths(self) -> dict[int, list[str]]:
        """Conditions that lead to every node."""
        paths: dict[int, list[str]] = {0: []}
        for node in sorted(self.splits, key=lambda n: n.depth):
            paths[node.yes] = [*paths[node.nodeid], f"{node.feature} < {node.threshold}"]
            paths[node.no] = [*paths[node.nodeid], f"{node.feature} >= {node.threshold}"]
        return paths

    def _sides(self) -> list[tuple[int, int, str]]:
        """``(leaf, split above it, side)`` for every pair; at most leaves times depth rows."""
        out = []

        def walk(nodeid: int, above: list[tuple[int, str]]) -> None:
            node = self.by_id[nodeid]
            if not node.is_split:
                out.extend((nodeid, split, side) for split, side in above)
                return
            walk(node.yes, [*above, (nodeid, "left")])
            walk(node.no, [*above, (nodeid, "right")])

        walk(0, [])
        return out


def grow_level(
    df: DataFrame, features: Features, rules: SplitRules, open_nodes: Sequence[int], node: str, g: str, h: str
) -> dict[int, Row]:
    """Best split of every open node.

    One pass over the rows; one row per open node and feature comes back, whatever the number of rows.
    """
    sums = value_sums(df, features, node, open_nodes, g, h)
    best: dict[int, Row] = {}
    for row in best_splits(split_candidates(sums, features, rules), per_feature=True).collect():
        held = best.get(row["nodeid"])
        if held is None or (-row["gain"], row["feature"]) < (-held["gain"], held["feature"]):
            best[row["nodeid"]] = row
    return best


def grow_tree(
    df: DataFrame,
    features: Features,
    g: str,
    h: str,
    rules: SplitRules,
    max_depth: int,
    eta: float,
) -> Tree:
    """Grow level by level, one pass per level; ids are given breadth-first.

    A split brings the sums of its node and both children along, so leaves need no job of their own.
    ``g`` and ``h`` are SQL text over ``df``.
    """

    def leaf(nodeid: int, depth: int, sum_g: float, sum_h: float) -> Node:
        return Node(nodeid, depth, cover=sum_h, leaf=eta * rules.leaf_weight(sum_g, sum_h))

    nodes = {0: Node(0, 0)}
    frontier = [0]
    for depth in range(max_depth):
        if not frontier:
            break
        splits = grow_level(df, features, rules, frontier, Tree(list(nodes.values())).route_text(), g, h)
        grown = []
        for nodeid in sorted(splits):
            s = splits[nodeid]
            yes, no = len(nodes), len(nodes) + 1
            nodes[yes] = leaf(yes, depth + 1, s["left_g"], s["left_h"])
            nodes[no] = leaf(no, depth + 1, s["right_g"], s["right_h"])
            nodes[nodeid] = replace(
                nodes[nodeid],
                feature=split_feature_name(s["feature"], s["is_level"], s["level"]),
                threshold=s["threshold"],
                yes=yes,
                no=no,
                missing=no if s["missing_right"] else yes,
                gain=s["gain"],
                cover=s["tot_h"],
                leaf=None,
                source=s["feature"],
                is_level=s["is_level"],
                level=s["level"],
            )
            grown += [yes, no]
        frontier = grown
    if not nodes[0].is_split:
        totals = df.agg(F.expr(f"sum({g}) AS g"), F.expr(f"sum({h}) AS h")).first()
        nodes[0] = leaf(0, 0, totals["g"], totals["h"])
    return Tree(sorted(nodes.values(), key=lambda n: n.nodeid))


def fit_residual_tree(
    df: DataFrame,
    actual: str,
    exposure: str,
    max_depth: int = TREE_DEPTH,
    rules: SplitRules = SplitRules(),
    eta: float = TREE_ETA,
) -> Tree:
    """One Poisson tree with ``log(exposure)`` as offset; every other column is a feature.

    Rows are first merged over all features, since a tree cannot tell equal rows apart.
    """
    require_columns(df.columns, [actual, exposure])
    others = [c for c in df.columns if c not in (actual, exposure)]
    cells = (
        df.groupBy(*others)
        .agg(
            F.sum(F.col(actual).cast("double")).alias("__y"),
            F.sum(F.col(exposure).cast("double")).alias("__e"),
            F.count_if(~usable_counts(F.col(actual), F.col(exposure))).alias("__bad"),
        )
        .persist()
    )
    try:
        totals = cells.agg(F.sum("__bad").alias("bad"), F.count(F.lit(1)).alias("n_cells")).first()
        if not totals["n_cells"]:
            raise ValueError("there are no rows to fit a tree to")
        if totals["bad"]:
            raise ValueError(f"{totals['bad']} rows lack an actual or have a non-positive exposure")
        widen = exp(rules.max_delta_step)
        features = describe_features(cells, ["__y", "__e", "__bad"])
        return grow_tree(
            cells.coalesce(1 + totals["n_cells"] // CELLS_PER_TASK),
            features,
            g="__e - __y",
            h=f"__e * {text.number(widen)}",
            rules=rules,
            max_depth=max_depth,
            eta=eta,
        )
    finally:
        cells.unpersist()


def split_statistics(df: DataFrame, tree: Tree, actual: str, exposure: str) -> DataFrame:
    """Counts, A/E and Poisson deviance of every split and its two sides.

    The rows are aggregated once, to the leaves; all sums of the nodes above add up from there. A
    node without positive exposure raises when the result is read.
    """
    spark = df.sparkSession
    y, e = F.col(actual).cast("double"), F.col(exposure).cast("double")
    leaves = df.groupBy(tree.route().alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("y"),
        F.sum(e).alias("e"),
        F.sum(y_log_ratio(y, e)).alias("s"),
        F.count_if(F.coalesce(e <= 0, F.lit(True))).alias("bad"),
    )
    above = spark.createDataFrame(tree._sides(), "leaf int, nodeid int, side string")
    sides = {"parent": F.lit(True), "left": F.col("side") == "left", "right": F.col("side") == "right"}
    sums = []
    for side, inside in sides.items():
        for c in ("n", "y", "e", "s", "bad"):
            sums.append(F.sum(F.when(inside, F.col(c))).alias(f"{c}_{side}"))
    per_split = leaves.join(F.broadcast(above), "leaf").groupBy("nodeid").agg(*sums)

    paths = tree.paths()
    described = spark.createDataFrame(
        [
            (
                n.nodeid,
                f"{n.feature} < {n.threshold}",
                _path(paths[n.nodeid]),
                _path(paths[n.yes]),
                _path(paths[n.no]),
                n.feature,
                n.threshold,
                n.gain,
                n.cover,
            )
            for n in tree.splits
        ],
        "nodeid int, split_label string, path_pretty string, left_path_pretty string, "
        "right_path_pretty string, feature string, threshold double, xgb_gain double, xgb_cover double",
    )
    out = described.join(F.broadcast(per_split), "nodeid", "left")
    measures = {}
    for side in sides:
        total_e, bad = F.col(f"e_{side}"), F.col(f"bad_{side}")
        fine = F.coalesce((total_e > 0) & (bad == 0), F.lit(False))
        message = F.concat(F.lit(f"the {side} of node "), F.col("nodeid"), F.lit(" has non-positive exposure"))
        checked = F.when(fine, total_e).otherwise(F.raise_error(message).cast("double"))
        measures[f"n_{side}"] = F.col(f"n_{side}").cast("long")
        measures[f"sum_y_{side}"] = F.col(f"y_{side}")
        measures[f"sum_exp_{side}"] = checked
        measures[f"ae_{side}"] = F.col(f"y_{side}") / checked
        measures[f"dev_{side}"] = group_deviance(F.col(f"y_{side}"), checked, F.col(f"s_{side}"))
    out = out.select(
        *["nodeid", "split_label", "path_pretty", "left_path_pretty", "right_path_pretty", "feature", "threshold"],
        *["xgb_gain", "xgb_cover"],
        *[c.alias(name) for name, c in measures.items()],
    )
    return (
        out.withColumn("dev_children", F.col("dev_left") + F.col("dev_right"))
        .withColumn("dev_reduction", F.col("dev_parent") - F.col("dev_children"))
        .select(*SPLIT_COLUMNS)
        .orderBy("nodeid")
    )


def _path(conditions: Sequence[str]) -> str:
    return PATH_AND.join(conditions) if conditions else ROOT_PATH


def _node_rows(statistics: DataFrame) -> list[DataFrame]:
    """The statistics' sides as rows: parent, left and right of every split."""
    figures = {"n": "n", "sum_y": "sum_y", "sum_exp": "sum_exp", "ae": "ae", "dev": "dev"}
    return [
        statistics.select("nodeid", F.lit(side).alias("side"), *[F.col(f"{c}_{side}").alias(name) for c, name in figures.items()])
        for side in ("parent", "left", "right")
    ]


def tree_report(statistics: DataFrame, tree: Tree) -> DataFrame:
    """``(ord, depth, label, ae, y)`` per node: the root, then each subtree, siblings by label.

    The table has two rows per split, so one ordered window over it is small. Conditions are taken
    from the tree, as a level may hold the word that joins them in the statistics.
    """
    paths = tree.paths()
    rows = [(n.nodeid, side, paths[to]) for n in tree.splits for side, to in (("left", n.yes), ("right", n.no))]
    rows += [(n.nodeid, "parent", []) for n in tree.splits if n.nodeid == 0]
    steps = statistics.sparkSession.createDataFrame(rows, "nodeid int, side string, steps array<string>")
    parent, left, right = _node_rows(statistics)
    nodes = parent.unionByName(left).unionByName(right).join(F.broadcast(steps), ["nodeid", "side"])
    label = F.when(F.size("steps") == 0, F.lit("root")).otherwise(F.try_element_at("steps", F.lit(-1)))
    return nodes.select(
        F.row_number().over(W.orderBy("steps")).alias("ord"),
        F.size("steps").alias("depth"),
        label.alias("label"),
        "ae",
        F.col("sum_y").alias("y"),
    ).orderBy("ord")


def node_summary(statistics: DataFrame) -> DataFrame:
    """``(nodeid, side, n, sum_y, sum_exp, ae, dev)``: parent, left and right of every split, by node id."""
    parent, left, right = _node_rows(statistics)
    place = F.array_position(F.array(F.lit("parent"), F.lit("left"), F.lit("right")), F.col("side"))
    return parent.unionByName(left).unionByName(right).orderBy("nodeid", place)
