import numpy as np
import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators import wide, wide_levels
from aestudy.operators.design import Cat, Num, fit_design
from aestudy.operators.dictionary import level_dictionary
from aestudy.operators.glm import fit_glm_path
from aestudy.operators.wide import fit_wide_design, fit_wide_path

ALPHAS = [0.5, 1e-2, 1e-4]


@pytest.fixture(scope="module")
def rows(study):
    return study.withColumn("Year", F.col("Issue_Year").cast("string"))


@pytest.fixture(scope="module")
def core(rows):
    return fit_design(rows, [(Cat(C.SEX),), (Num(C.ATTAINED_AGE),)])


@pytest.fixture(scope="module")
def model(rows, core):
    return fit_wide_path(rows, fit_wide_design(rows, core, ["Year", C.FACE_BAND]), ALPHAS)


@pytest.fixture(scope="module")
def dense(rows):
    return fit_glm_path(rows, fit_design(rows, [(Cat(C.SEX),), (Num(C.ATTAINED_AGE),), (Cat("Year"),), (Cat(C.FACE_BAND),)]), ALPHAS)


def test_equals_the_dense_solver(rows, model, dense):
    core_names = ["intercept", *model.design.core.column_names]
    for i in range(len(ALPHAS)):
        expected = dense.by_name(i)
        assert np.allclose(model.coefficients[i][: len(core_names)], [expected[c] for c in core_names], atol=1e-6)
        assert np.allclose(np.sort(model.coefficients[i]), np.sort(list(expected.values())), atol=1e-6)
        ours = [r[0] for r in model.predict(rows, i, C.EXPECTED).orderBy(*rows.columns).select(C.PREDICTION).collect()]
        theirs = [r[0] for r in dense.predict(rows, i, C.EXPECTED).orderBy(*rows.columns).select(C.PREDICTION).collect()]
        assert np.allclose(ours, theirs, rtol=1e-6)


def test_scores_are_zero(rows, model):
    scores = model.path_scores(rows).collect()
    assert len(scores) == len(ALPHAS) * model.design.size
    assert max(abs(r["score"]) for r in scores) < 1e-7


def test_unknown_and_null_levels(rows, model):
    odd = rows.limit(1).withColumn("Year", F.explode(F.array(F.lit("none such"), F.lit(None), F.lit(min(r[0] for r in rows.select("Year").distinct().collect())))))
    found = {r["Year"]: r[C.PREDICTION] for r in model.predict(odd).collect()}
    assert found[None] is None
    base = next(v for k, v in found.items() if k not in (None, "none such"))
    assert found["none such"] == pytest.approx(base)


def test_rows_with_null_are_left_out(spark, rows, core, model):
    more = rows.unionByName(rows.limit(5).withColumn("Year", F.lit(None).cast("string")))
    again = fit_wide_path(more, model.design, ALPHAS[:1])
    assert again.n_rows == rows.count() and np.allclose(again.coefficients, model.coefficients[:1], atol=1e-9)


def test_bad_input_raises(rows, model):
    with pytest.raises(ValueError, match="no rows"):
        fit_wide_path(rows.limit(0), model.design, ALPHAS)
    with pytest.raises(ValueError, match="positive penalties"):
        fit_wide_path(rows, model.design, [0.0])
    with pytest.raises(ValueError, match="non-positive"):
        fit_wide_path(rows.withColumn(C.EXPECTED, F.lit(0.0)), model.design, ALPHAS)


def test_dictionary_numbers_sorted_levels(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 20_011)).alias("a b"))
    found = level_dictionary(df, "a b")
    rows = found.table.orderBy("position").collect()
    values = sorted({r[0] for r in df.distinct().collect()} - {None})
    assert [r["level"] for r in rows] == values and [r["position"] for r in rows] == list(range(len(values)))
    assert found.n_levels == len(values)
    for limit in (0, 1 << 30):
        coded = found.encode(df.select("`a b`").union(spark.createDataFrame([("new",)], "a string")), "p", broadcast_bytes=limit)
        assert coded.count() == 60_001 and coded.where("p IS NULL").count() == df.where("`a b` IS NULL").count() + 1


def test_empty_dictionary(spark):
    found = level_dictionary(spark.createDataFrame([(None,)], "a string"), "a")
    assert found.n_levels == 0 and found.table.count() == 0


def test_wide_scoring_is_generated_code(spark):
    rows = spark.range(20_000).select(
        F.concat(F.lit("k"), F.col("id") % 6_000).alias("k"), F.lit("a").alias("c"), (F.col("id") % 3).cast("double").alias("y"), F.lit(1.5).alias("e")
    )
    model = fit_wide_path(rows, fit_wide_design(rows, fit_design(rows, [(Cat("c"),)]), ["k"]), [1e-2], "y", "e")
    assert model.design.size == 2 + 5_999
    scored = model.predict(rows, exposure="e")
    assert max(abs(r["score"]) for r in model.path_scores(rows, "y", "e").collect()) < 1e-7
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = model.predict(rows, exposure="e")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in plan and plan.lstrip().startswith("*(")
    assert scored.agg(F.sum(C.PREDICTION)).first()[0] == pytest.approx(sum(i % 3 for i in range(20_000)), rel=1e-6)


def test_one_wide_category_has_no_limit_and_splits_levels(spark, rows, core, monkeypatch):
    monkeypatch.setattr(wide, "MAX_COEFFICIENTS", 10)
    monkeypatch.setattr(wide_levels, "CELLS_PER_TASK", 10)
    monkeypatch.setattr(wide_levels, "SUMS_PER_PASS", 12)
    more = rows.unionByName(rows.limit(5).withColumns({"Year": F.lit("only here"), C.SEX: F.lit(None).cast("string")}))
    model = fit_wide_path(more, fit_wide_design(more, core, ["Year"]), ALPHAS[:2])
    dense = fit_glm_path(rows, fit_design(rows, [(Cat(C.SEX),), (Num(C.ATTAINED_AGE),), (Cat("Year"),)]), ALPHAS[:2])
    for i in range(2):
        expected = np.sort([*dense.by_name(i).values(), 0.0])  # the level without a usable row
        assert np.allclose(np.sort(model.coefficients[i]), expected, atol=1e-6)
    scores = model.path_scores(more).collect()
    assert len({(r["alpha_index"], r["pos"]) for r in scores}) == len(scores) == 2 * model.design.size
    assert max(abs(r["score"]) for r in scores) < 1e-7
