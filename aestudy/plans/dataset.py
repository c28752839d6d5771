"""From the delimited source file to the published study table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aestudy.functions.cleaning import band_issue_year, clean_strings
from aestudy.sources.tables import STUDY_SCHEMA, overwrite_table, read_delimited


def imported(spark: SparkSession, path: str, schema: T.StructType | None = STUDY_SCHEMA) -> DataFrame:
    """The source rows; ``schema=None`` infers types at the cost of one more pass."""
    return read_delimited(spark, path, schema=schema, infer_schema=schema is None)


def cleaned(raw: DataFrame) -> DataFrame:
    return clean_strings(raw)


def banded(clean: DataFrame) -> DataFrame:
    return band_issue_year(clean)


def build_dataset(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    schema: T.StructType | None = STUDY_SCHEMA,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Import, clean and band; with ``table`` the result is rebuilt as a catalog table."""
    study = banded(cleaned(imported(spark, path, schema)))
    return study if table is None else overwrite_table(study, table, partition_by)
