import numpy as np
import pytest
from pyspark.sql import functions as F

from aestudy.operators.splits import Features, SplitRules, describe_features, split_candidates, value_sums, with_running_sums
from aestudy.operators.tree import (
    SPLIT_COLUMNS,
    Node,
    Tree,
    fit_residual_tree,
    node_summary,
    split_statistics,
    tree_report,
)

DDL = "age double, year int, sex string, band string, y double, e double"
H_FACTOR = float(np.exp(0.7))


def make_rows(n=700, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        age = None if rng.random() < 0.2 else float(rng.integers(20, 60)) / 2
        sex = str(rng.choice(["F", "M"]))
        band = None if rng.random() < 0.1 else str(rng.choice(["a", "b", "it's"]))
        e = float(rng.integers(1, 20)) / 4
        rate = 0.4 + 1.2 * (age is None) + 0.5 * (sex == "M") + 0.8 * (band == "it's")
        rows.append((age, int(rng.integers(2000, 2006)), sex, band, float(rng.poisson(e * rate)), e))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    data = make_rows()
    df = spark.createDataFrame(data, DDL).repartition(3).cache()
    df.count()
    return data, df


def gain(g, h, lam=1.0, step=0.7):
    w = np.clip(-g / (h + lam), -step, step)
    return -(2 * g * w + (h + lam) * w * w)


COLUMNS = ["age", "year", "sex", "band"]
FIRST_LEVEL = {"sex": "F", "band": "a"}


def brute_force(data, min_child=1.0):
    """All admissible splits ``(feature, level, threshold, missing_right, gain)`` of some rows."""
    y, e = (np.array([r[i] for r in data]) for i in (4, 5))
    g, h = e - y, e * H_FACTOR
    found = []

    def consider(feature, level, threshold, left, missing_right):
        gl, hl = g[left].sum(), h[left].sum()
        gr, hr = g.sum() - gl, h.sum() - hl
        value = gain(gl, hl) + gain(gr, hr) - gain(g.sum(), h.sum())
        if min(hl, hr) >= min_child and value > 1e-6:
            found.append((feature, level, threshold, missing_right, value))

    for i, name in ((0, "age"), (1, "year")):
        x = np.array([np.nan if r[i] is None else r[i] for r in data], dtype=float)
        missing = np.isnan(x)
        values = np.unique(x[~missing])
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            consider(name, None, cut, (x < cut) | missing, False)
            if missing.any():
                consider(name, None, cut, x < cut, True)
        if missing.any() and len(values):
            consider(name, None, values[-1] + abs(values[-1]) + 1e-6, ~missing, True)
    for i, name in ((2, "sex"), (3, "band")):
        column = [r[i] for r in data]
        for v in set(column) - {FIRST_LEVEL[name]}:
            consider(name, v, 0.5, np.array([c != v for c in column]), False)
    return found


def goes_left(row, feature, level, threshold, missing_right):
    value = row[COLUMNS.index(feature)]
    if feature in FIRST_LEVEL:
        return value != level
    return (not missing_right) if value is None else value < threshold


def as_map(found):
    return {(f, level, round(t, 9), bool(right)): v for f, level, t, right, v in found}


def candidates(df, features, rules=SplitRules()):
    sums = value_sums(df, features, "0", [0], "e - y", f"e * {H_FACTOR!r}D")
    rows = split_candidates(sums, features, rules).collect()
    return as_map([(r.feature, r.level, r.threshold, r.missing_right, r.gain) for r in rows])


def test_candidates_equal_brute_force(rows):
    data, df = rows
    found, expected = candidates(df, describe_features(df, ["y", "e"])), as_map(brute_force(data))
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-9) for k in expected)


def test_candidates_do_not_depend_on_the_ranges(spark, rows):
    """Dealing a feature's values over many ranges changes who sorts them, not the result."""
    data, df = rows
    features = describe_features(df, ["y", "e"])
    sums = value_sums(df, features, "0", [0], "e - y", f"e * {H_FACTOR!r}D")
    together, expected = candidates(df, features), as_map(brute_force(data))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        parts = with_running_sums(sums).groupBy("feature").agg(F.count_distinct("part").alias("n")).collect()
        spread = candidates(df, features)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r["feature"]: r["n"] for r in parts}["age"] > 4
    assert spread.keys() == together.keys() == expected.keys()
    assert all(spread[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-9) for k in expected)


def check_subtree(tree, nodeid, data, depth):
    """The node's split has the largest gain there is, and so have the splits below it."""
    node = tree.by_id[nodeid]
    found = brute_force(data) if depth else []
    if not found:
        assert not node.is_split
        return 1
    best = max(s[4] for s in found)
    assert node.gain == pytest.approx(best, rel=1e-9)
    split = (node.source, node.level, node.threshold, node.missing == node.no)
    assert any(
        s[:2] == split[:2] and s[2] == pytest.approx(split[2]) and s[3] == split[3] and s[4] == pytest.approx(best, rel=1e-9)
        for s in found
    )
    left = [r for r in data if goes_left(r, *split)]
    right = [r for r in data if not goes_left(r, *split)]
    return 1 + check_subtree(tree, node.yes, left, depth - 1) + check_subtree(tree, node.no, right, depth - 1)


def test_fitted_tree_is_greedy_at_every_node(spark, rows):
    """Categories, missing values and deeper levels, against a recursion over the rows."""
    data, df = rows
    tree = fit_residual_tree(df, "y", "e")
    assert check_subtree(tree, 0, data, 3) == len(tree.nodes)
    assert {n.is_level for n in tree.splits} == {True, False}
    assert [n.nodeid for n in tree.nodes] == list(range(len(tree.nodes)))
    assert [n.depth for n in tree.nodes] == sorted(n.depth for n in tree.nodes)
    assert Tree.from_frame(tree.to_frame(spark)).nodes == tree.nodes


def test_leaves_carry_the_shrunken_node_weight(rows):
    data, df = rows
    tree = fit_residual_tree(df, "y", "e", max_depth=1)
    root = tree.by_id[0]
    split = (root.source, root.level, root.threshold, root.missing == root.no)
    for child, side in ((root.yes, True), (root.no, False)):
        part = [r for r in data if goes_left(r, *split) == side]
        g, h = sum(r[5] - r[4] for r in part), sum(r[5] for r in part) * H_FACTOR
        assert tree.by_id[child].leaf == pytest.approx(0.3 * np.clip(-g / (h + 1), -0.7, 0.7))
        assert tree.by_id[child].cover == pytest.approx(h)


def test_high_gamma_leaves_one_leaf(rows):
    data, df = rows
    tree = fit_residual_tree(df, "y", "e", rules=SplitRules(gamma=1e9))
    assert len(tree.nodes) == 1 and tree.nodes[0].leaf is not None
    assert tree.nodes[0].cover == pytest.approx(sum(r[5] for r in data) * H_FACTOR)


def deviance(part):
    y, e = (np.array([r[i] for r in part]) for i in (4, 5))
    mu = e * max(y.sum() / e.sum(), 1e-15)
    return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))


def test_split_statistics_equal_row_sums(rows):
    data, df = rows
    tree = fit_residual_tree(df, "y", "e")
    stats = split_statistics(df, tree, "y", "e")
    assert stats.columns == SPLIT_COLUMNS
    by_id = {r.nodeid: r for r in stats.collect()}
    assert list(by_id) == [n.nodeid for n in tree.splits]

    def walk(nodeid, part, path):
        node = tree.by_id[nodeid]
        if not node.is_split:
            return
        r = by_id[nodeid]
        split = (node.source, node.level, node.threshold, node.missing == node.no)
        left = [x for x in part if goes_left(x, *split)]
        right = [x for x in part if not goes_left(x, *split)]
        assert (r.n_parent, r.n_left, r.n_right) == (len(part), len(left), len(right))
        assert r.sum_y_left == sum(x[4] for x in left) and r.sum_exp_right == pytest.approx(sum(x[5] for x in right))
        assert r.ae_parent == pytest.approx(sum(x[4] for x in part) / sum(x[5] for x in part))
        assert r.dev_parent == pytest.approx(deviance(part)) and r.dev_left == pytest.approx(deviance(left))
        assert r.dev_reduction == pytest.approx(deviance(part) - deviance(left) - deviance(right), abs=1e-8)
        assert r.split_label == f"{node.feature} < {node.threshold}"
        assert r.path_pretty == (" AND ".join(path) or "ROOT")
        walk(node.yes, left, [*path, f"{node.feature} < {node.threshold}"])
        walk(node.no, right, [*path, f"{node.feature} >= {node.threshold}"])

    walk(0, data, [])


SMALL = Tree(
    [
        Node(0, 0, "age", 30.0, 1, 2, 2, 1.0, 1.0, None, "age"),
        Node(1, 1, "sex_M", 0.5, 3, 4, 3, 1.0, 1.0, None, "sex", True, "M"),
        Node(2, 1, leaf=0.5),
        Node(3, 2, leaf=0.1),
        Node(4, 2, leaf=0.2),
    ]
)


def test_routing_of_missing_and_unknown_values(spark):
    df = spark.createDataFrame(
        [(29.0, "M"), (29.0, "F"), (29.0, None), (30.0, "M"), (None, "M"), (float("nan"), "F")], "age double, sex string"
    )
    assert [r[0] for r in df.select(SMALL.route()).collect()] == [4, 3, 3, 2, 2, 2]
    assert [r[0] for r in df.select(SMALL.leaf_value()).collect()] == [0.2, 0.1, 0.1, 0.5, 0.5, 0.5]


def test_report_lists_subtrees_in_order(spark):
    df = spark.createDataFrame([(20.0, "M", 1.0, 2.0), (20.0, "F", 0.0, 1.0), (40.0, "F", 3.0, 1.0)], "age double, sex string, y double, e double")
    report = tree_report(split_statistics(df, SMALL, "y", "e"), SMALL).collect()
    assert [(r.ord, r.depth, r.label, r.y) for r in report] == [
        (1, 0, "root", 4.0),
        (2, 1, "age < 30.0", 1.0),
        (3, 2, "sex_M < 0.5", 0.0),
        (4, 2, "sex_M >= 0.5", 1.0),
        (5, 1, "age >= 30.0", 3.0),
    ]
    nodes = [(r.nodeid, r.side, r.n, r.sum_y) for r in node_summary(split_statistics(df, SMALL, "y", "e")).collect()]
    assert nodes == [(0, "parent", 3, 4.0), (0, "left", 2, 1.0), (0, "right", 1, 3.0), (1, "parent", 2, 1.0), (1, "left", 1, 0.0), (1, "right", 1, 1.0)]
    zero = split_statistics(df, SMALL, "y", "e").filter("nodeid = 1").first()
    assert zero.ae_left == 0.0 and zero.dev_left == pytest.approx(2e-15, rel=1e-6)


def test_nodes_without_exposure_raise(spark):
    df = spark.createDataFrame([(20.0, "M", 1.0, 2.0), (40.0, "F", 3.0, 1.0)], "age double, sex string, y double, e double")
    with pytest.raises(Exception, match="left of node 1 has non-positive exposure"):
        split_statistics(df, SMALL, "y", "e").collect()
    negative = df.withColumn("e", F.col("e") - 1.5)
    with pytest.raises(ValueError, match="1 rows lack"):
        fit_residual_tree(negative, "y", "e")


def test_missing_response_column_raises(rows):
    with pytest.raises(ValueError, match="nothing"):
        fit_residual_tree(rows[1], "nothing", "e")
    with pytest.raises(ValueError, match="no feature"):
        describe_features(rows[1].select("y", "e"), ["y", "e"])


def test_features_know_their_columns(rows):
    features = describe_features(rows[1], ["y", "e"])
    assert features == Features(["age", "year"], ["sex", "band"], {"sex": "F", "band": "a"})


def test_levels_with_the_joining_word_keep_depth_and_label(spark):
    df = spark.createDataFrame([("P AND Q", 1.0, 2.0), ("x", 3.0, 1.0)], "kind string, y double, e double")
    tree = Tree([Node(0, 0, "kind_P AND Q", 0.5, 1, 2, 1, 1.0, 1.0, None, "kind", True, "P AND Q"), Node(1, 1, leaf=0.1), Node(2, 1, leaf=0.2)])
    report = [(r.depth, r.label) for r in tree_report(split_statistics(df, tree, "y", "e"), tree).collect()]
    assert report == [(0, "root"), (1, "kind_P AND Q < 0.5"), (1, "kind_P AND Q >= 0.5")]


def test_infinite_values_can_be_split(spark):
    data = [(v, y, 4.0) for v, y in ((float("-inf"), 9.0), (1.0, 1.0), (2.0, 1.0), (float("inf"), 9.0)) for _ in range(20)]
    fitted = fit_residual_tree(spark.createDataFrame(data, "x double, y double, e double"), "y", "e")
    assert {n.threshold for n in fitted.splits} == {1.0, float("inf")}
