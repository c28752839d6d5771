import numpy as np
import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators import boost
from aestudy.operators.boost import BoostModel, bin_cuts, fit_boost
from aestudy.operators.encode import number_column, one_hot_columns, study_encoding
from aestudy.operators.splits import SplitRules
from aestudy.operators.tree import Node, Tree, grow_tree

OPTIONS = dict(learning_rate=0.3, rules=SplitRules(gamma=0.0), max_depth=2)


@pytest.fixture(scope="module")
def halves(study):
    return study.filter("Observation_Year <= 2016"), study.filter("Observation_Year > 2016")


@pytest.fixture(scope="module")
def model(halves):
    return fit_boost(*halves, study_encoding(), max_rounds=4, **OPTIONS)


def arrays(df):
    rows = df.select(*[e.value().alias(e.name) for e in study_encoding()], C.ACTUAL, C.EXPECTED).collect()
    data = np.array([list(r) for r in rows], dtype=float)
    return data[:, :-2], data[:, -2], data[:, -1]


def plain_tree(x, g, h, depth, eta):
    """Leaf value per row of one greedy tree, by trying every cut."""

    def gain(gs, hs):
        w = np.clip(-gs / (hs + 1), -0.7, 0.7)
        return -(2 * gs * w + (hs + 1) * w * w)

    best = (1e-6, None)
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for lo, hi in zip(values, values[1:]):
                left = x[:, j] < (lo + hi) / 2
                hl, hr = h[left].sum(), h[~left].sum()
                if min(hl, hr) < 1:
                    continue
                value = gain(g[left].sum(), hl) + gain(g[~left].sum(), hr) - gain(g.sum(), h.sum())
                if value > best[0] + 1e-9:
                    best = (value, (j, (lo + hi) / 2))
    if best[1] is None:
        return (lambda z: np.full(len(z), eta * np.clip(-g.sum() / (h.sum() + 1), -0.7, 0.7)))
    j, cut = best[1]
    left = x[:, j] < cut
    low = plain_tree(x[left], g[left], h[left], depth - 1, eta)
    high = plain_tree(x[~left], g[~left], h[~left], depth - 1, eta)

    def value(z):
        out = np.empty(len(z))
        side = z[:, j] < cut
        out[side], out[~side] = low(z[side]), high(z[~side])
        return out

    return value


def test_fit_equals_boosting_on_unmerged_rows(halves, model):
    (x, y, e), (xv, yv, ev) = arrays(halves[0]), arrays(halves[1])
    f, fv, losses = np.zeros(len(y)), np.zeros(len(yv)), []
    for _ in range(4):
        mu = e * np.exp(f)
        tree = plain_tree(x, mu - y, mu * np.exp(0.7), 2, 0.3)
        f, fv = f + tree(x), fv + tree(xv)
        losses.append(np.mean(ev * np.exp(fv) - yv * fv))
    assert model.history == pytest.approx(losses, rel=1e-9)
    scored = model.predict(halves[1], iterations=4).select(C.PREDICTION).collect()
    assert [r[0] for r in scored] == pytest.approx(np.exp(fv), rel=1e-9)


def test_cuts_of_any_size_and_sign_are_respected(spark):
    cuts = [-1e17, -3.5, -1e-300, 5e-324, 2.0**53, 1e17]
    trees = [Tree([Node(0, 0, "x", c, 1, 2, 1, source="x"), Node(1, 1, leaf=2.0**-i), Node(2, 1, leaf=-(2.0**-i))]) for i, c in enumerate(cuts)]
    model = BoostModel([number_column("x")], trees, len(trees) - 1)
    values = [v for c in cuts for v in (np.nextafter(c, -np.inf), c, np.nextafter(c, np.inf))] + [1.0, 0.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for r in model.predict(df).collect():
        margin = sum(2.0**-i if r.x is None or r.x < c else -(2.0**-i) for i, c in enumerate(cuts))
        assert r[C.PREDICTION] == pytest.approx(np.exp(margin))


def test_prediction_keeps_columns(study, model):
    assert model.predict(study).columns == [*study.columns, C.PREDICTION]
    assert model.input_cols == ["Sex", "Smoker_Status", "Face_Amount_Band", "Attained_Age"]


def test_early_stopping_does_not_depend_on_the_block_length(spark):
    """Validation deaths run against the trained effect, so the loss soon rises."""
    train = spark.createDataFrame([("M", 90.0, 60.0), ("F", 30.0, 60.0)], "Sex string, Death_Count double, ExpDth_VBT2015wMI_Cnt double")
    valid = spark.createDataFrame([("M", 66.0, 60.0), ("F", 54.0, 60.0)], train.schema)
    fits = [
        fit_boost(train, valid, one_hot_columns("Sex", ["M", "F"]), max_rounds=30, patience=3, block=b, **OPTIONS)
        for b in (2, 5)
    ]
    for fit in fits:
        assert len(fit.trees) == len(fit.history) == fit.best_iteration + 4 < 30
        assert fit.history[fit.best_iteration] == min(fit.history)
        assert len(fit.used_trees()) == fit.best_iteration + 1
    assert fits[0].history == pytest.approx(fits[1].history, rel=1e-9)


def test_stopping_round():
    assert boost._stopping_round([5, 4, 3, 3, 3], 2) == 4
    assert boost._stopping_round([5, 4, 3, 3], 2) is None
    assert boost._stopping_round([1, 2, 2, 0], 2) == 2


def test_without_validation_all_rounds_are_kept(spark):
    train = spark.createDataFrame([("M", 90.0, 60.0), ("F", 30.0, 60.0)], "Sex string, Death_Count double, ExpDth_VBT2015wMI_Cnt double")
    fit = fit_boost(train, None, one_hot_columns("Sex", ["M", "F"]), max_rounds=2, **OPTIONS)
    assert len(fit.trees) == 2 and fit.best_iteration == 1 and fit.history == []


def test_features_with_many_values_are_binned(spark):
    df = spark.range(4000).selectExpr(
        "CAST(id AS DOUBLE) / 7 AS x", "CAST(id > 1000 AS DOUBLE) AS Death_Count", "1D AS ExpDth_VBT2015wMI_Cnt"
    )
    cuts = bin_cuts(df, ["x"], 16)["x"]
    assert cuts == [250 * i / 7 for i in range(16)]
    assert bin_cuts(df.repartition(7), ["x"], 16)["x"] == cuts and bin_cuts(df, ["x"], 4000) == {}
    heavy = df.unionByName(df.where("x < 1").crossJoin(df.sparkSession.range(1000).select()))
    assert len([c for c in bin_cuts(heavy, ["x"], 16)["x"] if c < 1]) == 7
    fit = fit_boost(df, None, [number_column("x")], max_rounds=1, max_bins=16, **OPTIONS)
    assert {n.threshold for n in fit.trees[0].splits} <= set(cuts)
    root = fit.trees[0].by_id[0]
    below = df.filter(F.col("x") < root.threshold).count()
    assert root.is_split and 0 < below < 4000


def test_long_ensembles(study):
    def tree(i):
        return Tree([Node(0, 0, "Attained_Age", 20.5 + i, 1, 2, 1, source="Attained_Age"), Node(1, 1, leaf=0.01), Node(2, 1, leaf=-0.01)])

    long = BoostModel([number_column("Attained_Age")], [tree(i % 60) for i in range(100)], 99)
    for r in long.predict(study).select("Attained_Age", C.PREDICTION).limit(20).collect():
        margin = sum(0.01 if r[0] < 20.5 + i % 60 else -0.01 for i in range(100))
        assert r[1] == pytest.approx(np.exp(margin))


def test_bad_counts_raise(spark):
    df = spark.createDataFrame([("M", 1.0, 0.0)], "Sex string, Death_Count double, ExpDth_VBT2015wMI_Cnt double")
    with pytest.raises(ValueError, match="1 rows lack"):
        fit_boost(df, None, one_hot_columns("Sex", ["M", "F"]))


def test_guesses_do_not_change_trees(spark, halves):
    """Trees grown with remembered splits are those of a grower without memory, in fewer passes."""
    study = halves[0].withColumn("Attained_Age", F.when(F.col("Attained_Age") % 7 != 0, F.col("Attained_Age")))
    encoding = study_encoding()
    cells, features = boost.boost_cells(study, None, encoding, C.ACTUAL, C.EXPECTED, 256)
    layout = boost.feature_layout(cells, features)
    blocks = boost.persist_blocks(boost.block_cells(cells.repartition(3), layout))
    grown, passes = {}, {}
    for remembers in (True, False):
        grower = boost.TreeGrower(layout, SplitRules(gamma=0.0), 3, 0.1)
        trees, flat = [], []
        for _ in range(12):
            if not remembers:
                grower.last.clear()
            known = {}
            grower.sums(blocks, flat, known, {})
            trees.append(grower.grow(blocks, flat, known))
            flat.append(boost._flatten(trees[-1], layout.names))
        grown[remembers], passes[remembers] = trees, grower.passes
    assert passes[False] == 36 and passes[True] < 30
    for a, b in zip(grown[True], grown[False]):
        assert [(n.feature, n.threshold, n.yes, n.missing) for n in a.nodes] == [(n.feature, n.threshold, n.yes, n.missing) for n in b.nodes]
        assert [n.leaf for n in a.leaves] == pytest.approx([n.leaf for n in b.leaves], abs=1e-9)
    blocks.unpersist()


def test_histogram_trees_equal_level_trees(spark, halves):
    """The same tree as the SQL form grows level by level, missing values included."""
    study = halves[0].withColumn("Attained_Age", F.when(F.col("Attained_Age") % 7 != 0, F.col("Attained_Age")))
    cells, features = boost.boost_cells(study, None, study_encoding(), C.ACTUAL, C.EXPECTED, 256)
    layout = boost.feature_layout(cells, features)
    blocks, known = boost.block_cells(cells, layout), {}
    rules = SplitRules(gamma=0.0)
    grower = boost.TreeGrower(layout, rules, 3, 0.1)
    grower.sums(blocks, [], known, {})
    found = grower.grow(blocks, [], known)
    expected = grow_tree(cells, features, "__e - __y", f"__e * {np.exp(rules.max_delta_step)}D", rules, 3, 0.1)
    for a, b in zip(found.nodes, expected.nodes, strict=True):
        assert (a.nodeid, a.depth, a.feature, a.threshold, a.yes, a.no, a.missing, a.source) == (b.nodeid, b.depth, b.feature, b.threshold, b.yes, b.no, b.missing, b.source)
        assert (a.gain or 0, a.cover, a.leaf or 0) == pytest.approx((b.gain or 0, b.cover, b.leaf or 0))


def test_a_stopped_fit_goes_on(spark, halves, tmp_path, monkeypatch):
    options = OPTIONS | dict(max_rounds=8, block=3)
    whole = fit_boost(*halves, study_encoding(), **options)
    state, grow, grown = str(tmp_path / "fit"), boost.TreeGrower.grow, []

    def fail_in_round(n):
        def one(self, *args):
            if len(grown) == n:
                raise RuntimeError("lost")
            grown.append(1)
            return grow(self, *args)

        return one

    monkeypatch.setattr(boost.TreeGrower, "grow", fail_in_round(5))
    with pytest.raises(RuntimeError):
        fit_boost(*halves, study_encoding(), state=state, **options)
    spark.read.parquet(f"{state}/nodes").limit(2).withColumn("block", F.lit("unfinished")).write.mode("append").parquet(f"{state}/nodes")
    grown.clear()
    monkeypatch.setattr(boost.TreeGrower, "grow", fail_in_round(99))
    fit = fit_boost(*halves, study_encoding(), state=state, **options)
    assert len(grown) == 5 and fit.best_iteration == whole.best_iteration
    assert fit.history == pytest.approx(whole.history, rel=1e-12)
    for a, b in zip(fit.trees, whole.trees, strict=True):
        assert [(n.feature, n.threshold, n.missing) for n in a.nodes] == [(n.feature, n.threshold, n.missing) for n in b.nodes]
    with pytest.raises(ValueError, match="another fit"):
        fit_boost(*halves, study_encoding(), state=state, **options | dict(learning_rate=0.2))
