"""Batch scoring of unaggregated study rows, and the check of what was written."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from aestudy import columns as C
from aestudy.operators.boost import BoostModel
from aestudy.operators.glm import GLMPath
from aestudy.operators.study import actual_to_predicted, label_dataset, predicted_count, select_study
from aestudy.sources.models import load_model
from aestudy.sources.tables import overwrite_table, read_table


def score_rows(df: DataFrame, model: GLMPath | BoostModel, output: str = C.PREDICTION, **options) -> DataFrame:
    """Add a multiplier of expected to every row."""
    return model.predict(df, output=output, **options)


def post_score_check(scored: DataFrame) -> DataFrame:
    """Totals of predicted and actual counts and their ratios."""
    return actual_to_predicted(scored, predicted_count())


@dataclass(frozen=True)
class ScoringRun:
    table: str
    totals: Row


def _resolved(spark: SparkSession, table: str) -> tuple[str, ...]:
    """Catalog, namespace and name that a table identifier stands for."""
    parts = [p.lower() for p in re.findall(r"`(?:[^`]|``)+`|[^.`]+", table)]
    parts = [p[1:-1].replace("``", "`") if p.startswith("`") else p for p in parts]
    here = [spark.catalog.currentCatalog().lower(), spark.catalog.currentDatabase().lower()]
    return tuple([*here[: max(0, 3 - len(parts))], *parts])


def run_scoring(
    spark: SparkSession,
    model_path: str,
    input_table: str,
    output_table: str,
    cleaned: bool = False,
    last_train_year: int = C.LAST_TRAIN_YEAR,
    plan: str = C.TERM_PLAN,
    excluded_level: str = C.POST_LEVEL_EXCLUDED,
    **options,
) -> ScoringRun:
    """Select the study, label it, score every row, overwrite the output table and total it."""
    if _resolved(spark, input_table) == _resolved(spark, output_table):
        raise ValueError("the output table must not be the input table")
    model = load_model(spark, model_path)
    study = label_dataset(
        select_study(read_table(spark, input_table), plan, excluded_level, cleaned), last_train_year=last_train_year
    )
    written = overwrite_table(score_rows(study, model, **options), output_table)
    return ScoringRun(output_table, post_score_check(written).first())
