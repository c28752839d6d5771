import numpy as np
import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.design import Cat, Num, Spline, cross, fit_design
from aestudy.operators.factors import FactorAnalysis, group_members, join_factors, long_factors
from aestudy.operators.glm import GLMPath, fit_glm_path
from aestudy.operators.grid import occurring_combinations
from aestudy.operators.lookup import many_to_one_join, unmatched_keys

AGE = "cr(Attained_Age, df=4, lower_bound=18, upper_bound=90)"
AGE_SMOKER_SEX = "Attained_Age_x_Smoker_Status_x_Sex"


@pytest.fixture(scope="module")
def model(study):
    age, smoker, sex, band = Spline("Attained_Age"), Cat("Smoker_Status", "NS"), Cat("Sex", "F"), Cat("Face_Amount_Band")
    terms = [*cross(age, smoker, sex), *cross(band, sex), *cross(band, smoker)]
    return fit_glm_path(study, fit_design(study, terms), [1.0, 1e-3])


@pytest.fixture()
def analysis(spark, model):
    return FactorAnalysis(spark, model, 1)


def test_terms_join_the_widest_group_that_holds_their_variables(spark):
    rows = [(a, b, c, d) for a in "pq" for b in "rs" for c in "tu" for d in (1, 2)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d int")
    a, b, c, d = Cat("a"), Cat("b"), Cat("c"), Num("d")
    design = fit_design(df, [(a,), (b,), (c,), (d,), (a, b), (b, c), (d, c)])
    model = GLMPath(design, [0.0], [0.0], [[0.0] * len(design.columns)])
    groups = {g: sorted({t for t in m if t != "intercept"}) for g, m in ((r.term_group, r.model_terms) for r in group_members(FactorAnalysis(spark, model).factor_map()).collect())}
    # Three pairs are equally wide; each main effect goes to the first that holds it.
    assert groups == {"intercept": [], "a_x_b": ["a", "a:b", "b"], "b_x_c": ["b:c", "c"], "c_x_d": ["d", "d:c"]}


def test_groups_of_the_study_model(analysis):
    assert list(analysis.groups) == ["intercept", AGE_SMOKER_SEX, "Sex_x_Face_Amount_Band", "Smoker_Status_x_Face_Amount_Band"]


def test_factor_map_lists_coefficients_in_order(analysis, model):
    rows = analysis.factor_map().collect()
    assert analysis.factor_map().columns == ["term", "term_value", "model_term", "term_group"]
    assert {r.term: r.term_value for r in rows} == model.by_name(1)
    assert [r.term for r in rows] == list(model.by_name(1))


def test_factors_reconstruct_predictions(analysis, study):
    tables = analysis.factor_tables(study)
    assert tables["intercept"].count() == 1
    ages, smokers, sexes = 81, 3, 2
    assert tables[AGE_SMOKER_SEX].count() == ages * smokers * sexes
    assert tables[AGE_SMOKER_SEX].columns == ["Attained_Age", "Smoker_Status", "Sex", "factor", "term_group"]
    joined = analysis.append_factors(study, tables)
    assert joined.filter(" OR ".join(f"`factor_{g}` IS NULL" for g in tables)).count() == 0
    assert analysis.reconstructs(study, tables)
    analysis.check(study, tables)
    wrong = {**tables, "intercept": tables["intercept"].withColumn("factor", F.col("factor") * 1.001)}
    with pytest.raises(ValueError, match="does not match"):
        analysis.check(study, wrong)


def test_shuffled_and_broadcast_joins_agree(analysis, study):
    tables = analysis.factor_tables(study)
    shuffled = analysis.append_factors(study, tables, broadcast_bytes=0)
    assert "BroadcastHashJoin" not in str(shuffled._jdf.queryExecution().executedPlan())
    total = shuffled.agg(F.sum("model_pred")).first()[0]
    assert total == pytest.approx(analysis.append_factors(study, tables).agg(F.sum("model_pred")).first()[0], rel=1e-12)


def test_user_groups(analysis, study):
    changed = (
        analysis.factor_map()
        .withColumn("term_group", F.when(F.col("term_group") == AGE_SMOKER_SEX, "Ages").otherwise(F.col("term_group")))
        .withColumn("term_group", F.when(F.col("model_term").startswith("Face_Amount_Band"), "Bands").otherwise(F.col("term_group")))
        .drop("term_value", "model_term")
        .orderBy(F.rand(1))
    )
    analysis.set_factor_map(changed)
    assert list(analysis.groups) == ["intercept", "Ages", "Bands"]
    assert analysis.group_variables("Bands") == ["Smoker_Status", "Sex", "Face_Amount_Band"]
    tables = analysis.factor_tables(study)
    assert list(tables) == ["intercept", "Ages", "Bands"]
    assert analysis.reconstructs(study, tables)


def test_bad_factor_maps_raise(analysis):
    good = analysis.factor_map()
    one = good.filter("term = 'Sex[T.M]'")
    with pytest.raises(ValueError, match="term_group"):
        analysis.set_factor_map(good.drop("term_group"))
    with pytest.raises(ValueError, match="duplicate.*Sex"):
        analysis.set_factor_map(good.unionByName(one))
    with pytest.raises(ValueError, match="missing.*Sex"):
        analysis.set_factor_map(good.subtract(one))
    with pytest.raises(ValueError, match="unexpected.*Other"):
        analysis.set_factor_map(good.unionByName(one.withColumn("term", F.lit("Other"))))
    with pytest.raises(ValueError, match="term_value"):
        analysis.set_factor_map(good.withColumn("term_value", F.col("term_value") + 1e-6))


def test_grid_limit(analysis, study):
    with pytest.raises(ValueError, match="more than 10"):
        analysis.factor_tables(study, max_rows=10)


def test_missing_factor_counts_as_one_or_raises(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    tables = {
        "intercept": spark.createDataFrame([(2.0, "intercept")], "factor double, term_group string"),
        "k": spark.createDataFrame([("a", 3.0, "k"), (None, 5.0, "k")], "k string, factor double, term_group string"),
    }
    out = {r.n: r.model_pred for r in join_factors(df, tables, strict=False).collect()}
    assert out == {1: 6.0, 2: 2.0, 3: 10.0}
    with pytest.raises(Exception, match="no factor_k"):
        join_factors(df, tables).collect()


def test_repeated_lookup_keys_raise(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    with pytest.raises(ValueError, match="not unique"):
        many_to_one_join(table.select("k"), table, ["k"], "v", "out")


def test_hot_lookup_key_keeps_every_row(spark):
    """A third of the rows carry one key, on a table too large to broadcast."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id")
    table = spark.range(40_000).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")
    out = many_to_one_join(df, table, ["k"], "v", "out", broadcast_bytes=100)
    assert out.count() == 30_000
    assert out.agg(F.sum(F.col("out") - F.col("k"))).first()[0] == 0


def test_unmatched_keys(spark):
    left, right = (spark.createDataFrame([(v,) for v in vs], "k string") for vs in ("ab", "bc"))
    assert sorted(tuple(r) for r in unmatched_keys(left, right, "k").collect()) == [("missing", "a"), ("unexpected", "c")]


def test_long_form_has_null_where_a_group_lacks_a_variable(analysis, study):
    long = long_factors(analysis.factor_tables(study))
    assert long.filter("term_group = 'intercept' AND Sex IS NULL AND Attained_Age IS NULL").count() == 1


def test_leftover_terms_share_a_group_by_variable(spark, study):
    design = fit_design(study, [(Spline("Attained_Age"),), (Cat("Sex", "M"),)])
    analysis = FactorAnalysis(spark, GLMPath(design, [0.0], [0.1], [list(np.linspace(-1, 1, len(design.columns)))]))
    assert list(analysis.groups) == ["intercept", "Attained_Age", "Sex"]
    assert analysis.reconstructs(study.filter(F.col(C.ACTUAL) >= 0), analysis.factor_tables(study))


def test_values_beyond_the_training_range_are_covered_by_the_scored_frame(spark, study):
    design = fit_design(study, [(Num("Attained_Age"),), (Cat("Sex", "M"),)])
    analysis = FactorAnalysis(spark, GLMPath(design, [0.0], [0.1], [list(np.linspace(-0.3, 0.02, len(design.columns)))]))
    old = study.limit(5).withColumn("Attained_Age", F.lit(140))
    with pytest.raises(Exception, match="no factor_Attained_Age"):
        analysis.append_factors(old, analysis.factor_tables(study)).collect()
    both = analysis.predict_by_factors(analysis.model.predict(old, 0, output="direct")).collect()
    assert [r.model_pred for r in both] == pytest.approx([r.direct for r in both], rel=1e-12)


def test_combinations_that_occur(spark):
    data = [(1, "a", 0.5), (1, "a", 2.5), (1, "a", 0.5), (2, None, 0.5), (None, "b", 0.5), (2, "b", None)]
    df = spark.createDataFrame(data, "k int, s string, x double")
    groups = [["k", "s"], ["x"], ["s", "k"], ["s", "x"]]
    pairs, numbers, turned, mixed = (sorted(tuple(r) for r in t.collect()) for t in occurring_combinations(df, groups))
    assert pairs == [(1, "a"), (2, "b")] and turned == [("a", 1), ("b", 2)]
    assert numbers == [(0.5,), (2.5,)] and mixed == [("a", 0.5), ("a", 2.5), ("b", 0.5)]
    assert [t.count() for t in occurring_combinations(df.limit(0), groups)] == [0] * 4


def test_a_wide_group_has_a_row_per_occurring_combination(spark):
    """The ranges multiply to 10^15 combinations; a fraction is a value as well."""
    data = [(0, 10**5, 0.25), (10**5, 0, 0.5), (10**5, 10**5, 10**5 + 0.5), (0, 10**5, 0.25)]
    df = spark.createDataFrame(data, "a int, b int, c double")
    design = fit_design(df, cross(Num("a"), Num("b"), Num("c")))
    analysis = FactorAnalysis(spark, GLMPath(design, [0.0], [0.1], [[1e-6, -1e-6, 1e-6, 1e-11, -1e-11, 1e-11, 1e-16]]))
    tables = analysis.occurring_factor_tables(df)
    assert list(tables) == ["intercept", "a_x_b_x_c"] and tables["a_x_b_x_c"].count() == 3
    both = analysis.predict_by_factors(analysis.model.predict(df, 0, output="direct")).collect()
    assert len(both) == 4 and [r.model_pred for r in both] == pytest.approx([r.direct for r in both], rel=1e-12)


def test_a_missing_feature_is_in_no_table_made_from_the_frame(spark, study):
    design = fit_design(study, [(Num("Attained_Age"),)])
    analysis = FactorAnalysis(spark, GLMPath(design, [0.0], [0.1], [[0.01]]))
    lacking = study.limit(2).withColumn("Attained_Age", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="no factor_Attained_Age"):
        analysis.predict_by_factors(lacking).collect()
