import numpy as np
import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.design import Cat, Num, Spline, cross, fit_design, order_terms, term_name
from aestudy.operators.glm import best_alpha, fit_glm_path, merge_cells, penalty_path
from aestudy.plans.training import study_terms

ALPHAS = [0.5, 1e-2, 1e-4]


@pytest.fixture(scope="module")
def design(study):
    return fit_design(study, study_terms())


@pytest.fixture(scope="module")
def model(study, design):
    return fit_glm_path(study, design, ALPHAS)


def matrix(df, design):
    """Design matrix, counts and exposures of every row, without merging."""
    rows = design.with_basis(df).select(C.ACTUAL, C.EXPECTED, *[design.feature(c) for c in design.columns]).collect()
    data = np.array([list(r) for r in rows], dtype=float)
    return data[:, 2:], data[:, 0], data[:, 1]


def newton(x, y, e, alpha):
    """Minimise deviance / (2 n) + alpha / 2 |b|^2 with a free intercept."""
    n = len(y)
    x1 = np.column_stack([np.ones(n), x])
    penalty = np.diag([0.0] + [alpha * n] * x.shape[1])
    b = np.zeros(x1.shape[1])
    b[0] = np.log(y.sum() / e.sum())
    for _ in range(60):
        mu = e * np.exp(x1 @ b)
        step = np.linalg.solve(x1.T @ (mu[:, None] * x1) + penalty, x1.T @ (y - mu) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-13:
            break
    return b


def test_terms_are_ordered_by_degree_and_kept_once():
    a, b = Cat("a"), Cat("b")
    terms = order_terms([*cross(a, b), (b,), (Num("n"),)])
    assert [term_name(t) for t in terms] == ["a", "b", "n", "a:b"]


def test_column_names_and_coding(design):
    names = design.column_names
    age = "cr(Attained_Age, df=4, lower_bound=18, upper_bound=90)"
    assert names[:4] == [f"{age}[{i}]" for i in (1, 2, 3, 4)]
    assert [n for n in names if n.startswith("Smoker_Status[") and ":" not in n] == [
        "Smoker_Status[NS]",
        "Smoker_Status[S]",
        "Smoker_Status[U]",
    ]
    assert [n for n in names if n.startswith("Sex[") and ":" not in n] == ["Sex[T.F]"]
    assert "Face_Amount_Band[T.02: 10,000 - 24,999]" in names and "Face_Amount_Band[T.05: 100,000 - 249,999]" not in names
    assert f"{age}[2]:Smoker_Status[T.U]:Sex[T.F]" in names
    assert len(names) == len(set(names)) == 4 + 3 + 1 + 2 + 8 + 4 + 2 + 8


def test_linear_predictor_equals_the_weighted_columns(study, design):
    rng = np.random.default_rng(0)
    weights = {n: float(w) for n, w in zip(design.column_names, rng.normal(size=len(design.columns)))}
    x, _, _ = matrix(study, design)
    score = design.with_basis(study).select(design.linear_predictor(weights).alias("s")).collect()
    assert [r.s for r in score] == pytest.approx(x @ np.array(list(weights.values())), abs=1e-12)


def test_fit_equals_newton_on_unmerged_rows(study, design, model):
    x, y, e = matrix(study, design)
    for i, alpha in enumerate(ALPHAS):
        b = newton(x, y, e, alpha)
        fitted = model.intercepts[i] + x @ np.array(model.coefficients[i])
        assert fitted == pytest.approx(b[0] + x @ b[1:], abs=1e-8)


def test_predict_with_and_without_exposure(study, design, model):
    x, _, e = matrix(study, design)
    multiplier = np.exp(model.intercepts[2] + x @ np.array(model.coefficients[2]))
    both = model.predict(model.predict(study, 2), 2, exposure=C.EXPECTED, output="mean")
    rows = both.select(C.PREDICTION, "mean").collect()
    assert [r[0] for r in rows] == pytest.approx(multiplier, rel=1e-12)
    assert [r[1] for r in rows] == pytest.approx(multiplier * e, rel=1e-12)
    assert both.columns == [*study.columns, C.PREDICTION, "mean"]


def test_path_stats_equal_row_by_row_scores(study, design, model):
    x, y, e = matrix(study, design)

    def deviance(mu):
        return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))

    null = deviance(np.full(len(y), y.mean()))
    expected = [1 - deviance(e * np.exp(b + x @ np.array(w))) / null for b, w in zip(model.intercepts, model.coefficients)]
    stats = model.path_stats(study)
    assert {r.alpha_index: r.d2 for r in stats.collect()} == pytest.approx(dict(enumerate(expected)), rel=1e-10)
    assert best_alpha(stats) == int(np.argmax(expected))


def test_coefficient_table(spark, model):
    rows = model.coefficient_table(spark, 1).orderBy("pos").collect()
    assert rows[0].term == "intercept" and rows[0].term_value == model.intercepts[1]
    assert [r.term for r in rows[1:]] == model.design.column_names
    assert model.coefficient_table(spark).count() == len(ALPHAS) * len(rows)


def test_rows_without_a_feature_are_left_out_and_counted(spark, study):
    holed = study.withColumn("Sex", F.when(F.col("Issue_Age") % 10 == 0, None).otherwise(F.col("Sex")))
    kept = holed.dropna(subset=["Sex"])
    terms = [(Cat("Sex", "M"),), (Num("Attained_Age"),)]
    with_holes = fit_glm_path(holed, fit_design(holed, terms), [1e-3])
    without = fit_glm_path(kept, fit_design(kept, terms), [1e-3])
    assert with_holes.n_dropped == study.count() - kept.count() > 0
    assert with_holes.coefficients[0] == pytest.approx(without.coefficients[0], abs=1e-9)
    scored = with_holes.predict(holed)
    assert scored.filter("Sex IS NULL AND prediction IS NOT NULL").count() == 0


def test_unknown_level_scores_as_the_baseline(spark, study):
    model = fit_glm_path(study, fit_design(study, [(Num("Attained_Age"),), (Cat("Sex", "M"),)]), [1e-3])
    df = spark.createDataFrame([("?", 40), (None, 40)], "Sex string, Attained_Age int")
    by_level = {r.Sex: r.prediction for r in model.predict(df).collect()}
    named = model.by_name()
    assert by_level["?"] == pytest.approx(np.exp(named["intercept"] + 40 * named["Attained_Age"]))
    assert by_level[None] is None


def test_merged_cells_keep_the_totals(study, design):
    merged = merge_cells(study, design, C.ACTUAL, C.EXPECTED)
    total = merged.agg(F.sum("n"), F.sum("y"), F.sum("e")).first()
    plain = study.agg(F.count(F.lit(1)), F.sum(C.ACTUAL), F.sum(C.EXPECTED)).first()
    assert tuple(total) == pytest.approx(tuple(plain))


def test_bad_counts_raise(study, design):
    with pytest.raises(ValueError, match="sum to zero"):
        fit_glm_path(study.withColumn(C.ACTUAL, F.lit(0.0)), design, [1.0])
    with pytest.raises(ValueError, match="positive"):
        fit_glm_path(study.withColumn(C.EXPECTED, F.lit(0.0)), design, [1.0])


def test_penalty_path():
    path = penalty_path(100)
    assert len(path) == 100 and path[0] == 10.0 and path[-1] == pytest.approx(1e-5)
    assert np.diff(np.log(path)) == pytest.approx(np.full(99, np.log(1e-6) / 99))


def test_spline_in_a_model_uses_training_knots_only(study):
    design = fit_design(study, [(Spline("Attained_Age"),)])
    only_young = study.filter("Attained_Age < 40")
    knots = design.knots["cr(Attained_Age, df=4, lower_bound=18, upper_bound=90)"]
    young = design.with_basis(only_young).select("Attained_Age", design.feature(design.columns[1])).collect()
    everyone = {r[0]: r[1] for r in design.with_basis(study).select("Attained_Age", design.feature(design.columns[1])).collect()}
    assert knots[0] == 18 and knots[-1] == 90
    assert all(everyone[r[0]] == r[1] for r in young)
