"""Training runs: study rows in, fitted models with their diagnostics out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.boost import BoostModel, fit_boost
from aestudy.operators.design import Cat, Spline, Term, cross, fit_design, term_name
from aestudy.operators.encode import EncodedColumn, study_encoding
from aestudy.operators.factors import FactorAnalysis
from aestudy.operators.glm import GLMPath, best_alpha, fit_glm_path
from aestudy.operators.study import actual_to_predicted, predicted_count, study_cells, subset
from aestudy.operators.tree import Tree, fit_residual_tree, split_statistics
from aestudy.sources.tables import record_run


def study_terms() -> list[Term]:
    """Age spline by smoker status by sex, and the face amount band."""
    age = Spline(C.ATTAINED_AGE, df=4, lower=18, upper=90)
    smoker = Cat(C.SMOKER, C.BASELINES[C.SMOKER])
    sex = Cat(C.SEX, C.BASELINES[C.SEX])
    band = Cat(C.FACE_BAND, C.BASELINES[C.FACE_BAND])
    return [*cross(age, smoker, sex), (band,)]


@dataclass
class GLMStudy:
    """A trained path with its diagnostics. ``cells`` stay cached until ``close``."""

    cells: DataFrame
    model: GLMPath
    alpha_index: int
    train_stats: DataFrame
    test_stats: DataFrame
    train_tree: Tree
    train_splits: DataFrame
    test_tree: Tree | None
    test_splits: DataFrame | None
    factors: FactorAnalysis
    factor_tables: dict[str, DataFrame]
    predicted_over_actual: float

    def close(self) -> None:
        self.cells.unpersist()


def residual_diagnosis(cells: DataFrame, model: GLMPath, alpha_index: int) -> tuple[Tree, DataFrame]:
    """Residual tree of a data set's cells on the model's fitted counts, and its split statistics."""
    complete = cells.dropna(subset=model.input_cols)
    fitted = model.predict(complete, alpha_index, exposure=C.EXPECTED, output="model_pred").drop(C.EXPECTED, C.DATASET)
    tree = fit_residual_tree(fitted, C.ACTUAL, "model_pred")
    return tree, split_statistics(fitted, tree, C.ACTUAL, "model_pred")


def train_glm_study(
    study: DataFrame,
    terms: Sequence[Term] | None = None,
    keys: Sequence[str] = tuple(C.REGRESSION_KEYS),
    alphas: Sequence[float] | None = None,
    alpha_index: int | None = None,
    records: str | None = None,
    run_id: str = "glm",
) -> GLMStudy:
    """Fit the regression path on the training cells of a labelled study and diagnose it.

    The study is read once, into cells. Without ``alpha_index`` the penalty that explains most test
    deviance is used (most training deviance when there are no test cells). With ``records`` the run's
    terms, penalty and ratio are appended to the record tables there.
    """
    cells = study_cells(study, keys).persist()
    train, test = subset(cells, C.TRAIN), subset(cells, C.TEST)
    design = fit_design(train, study_terms() if terms is None else terms)
    model = fit_glm_path(train, design, alphas)
    train_stats, test_stats = model.path_stats(train), model.path_stats(test)
    has_test = test.dropna(subset=design.variables).limit(1).count() > 0
    if alpha_index is None:
        alpha_index = best_alpha(test_stats if has_test else train_stats)
    train_tree, train_splits = residual_diagnosis(train, model, alpha_index)
    test_tree, test_splits = residual_diagnosis(test, model, alpha_index) if has_test else (None, None)
    factors = FactorAnalysis(study.sparkSession, model, alpha_index)
    complete = train.dropna(subset=design.variables)
    tables = factors.factor_tables(complete)
    factors.check(complete, tables)
    ratio = actual_to_predicted(model.predict(complete, alpha_index), predicted_count()).first()
    if records is not None:
        chosen = model.index(alpha_index)
        params = {"terms": " + ".join(term_name(t) for t in design.terms), "n_alphas": len(model.alphas), "alpha": model.alphas[chosen]}
        scores = train_stats.where(F.col("alpha_index") == chosen).first()
        record_run(study.sparkSession, records, run_id, params, {"predicted_over_actual": ratio["predicted_over_actual"], "train_d2": scores["d2"]})
    return GLMStudy(
        cells=cells,
        model=model,
        alpha_index=model.index(alpha_index),
        train_stats=train_stats,
        test_stats=test_stats,
        train_tree=train_tree,
        train_splits=train_splits,
        test_tree=test_tree,
        test_splits=test_splits,
        factors=factors,
        factor_tables=tables,
        predicted_over_actual=ratio["predicted_over_actual"],
    )


def train_boost_study(
    study: DataFrame,
    encoding: Sequence[EncodedColumn] | None = None,
    keys: Sequence[str] = tuple(C.BOOST_KEYS),
    records: str | None = None,
    run_id: str = "boost",
    **options,
) -> tuple[BoostModel, float]:
    """Boost on the training cells, stop on the test cells; also predicted/actual on the latter.

    With ``records`` the run's parameters, best iteration and ratio are appended there.
    """
    cells = study_cells(study, keys).persist()
    try:
        valid = subset(cells, C.TEST)
        model = fit_boost(subset(cells, C.TRAIN), valid, study_encoding() if encoding is None else encoding, **options)
        scored = model.predict(valid, exposure=C.EXPECTED)
        totals = actual_to_predicted(scored, C.PREDICTION).first()
        if records is not None:
            metrics = {"predicted_over_actual": totals["predicted_over_actual"], "best_iteration": model.best_iteration, "loss": model.history[model.best_iteration]}
            record_run(study.sparkSession, records, run_id, {"inputs": ", ".join(model.input_cols), **options}, metrics)
        return model, totals["predicted_over_actual"]
    finally:
        cells.unpersist()
