"""Readers, table sinks and run records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aestudy import columns as C
from aestudy.functions.cleaning import nan_to_null
from aestudy.operators.checks import require_columns

STUDY_SCHEMA = T.StructType(
    [
        T.StructField(C.PLAN, T.StringType()),
        T.StructField(C.POST_LEVEL, T.StringType()),
        T.StructField(C.OBSERVATION_YEAR, T.IntegerType()),
        T.StructField(C.ISSUE_YEAR, T.IntegerType()),
        T.StructField(C.ISSUE_AGE, T.IntegerType()),
        T.StructField(C.ATTAINED_AGE, T.IntegerType()),
        T.StructField(C.SEX, T.StringType()),
        T.StructField(C.SMOKER, T.StringType()),
        T.StructField(C.FACE_BAND, T.StringType()),
        T.StructField(C.ACTUAL, T.DoubleType()),
        T.StructField(C.EXPECTED, T.DoubleType()),
    ]
)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = "\t",
    header: bool = True,
    infer_schema: bool = False,
) -> DataFrame:
    """Read a delimited text file.

    With a header, the schema's fields are looked up by name and the file's other columns are not
    read; without one they are matched by position. Inference costs one more pass over the file,
    so it has to be asked for.
    """
    if schema is None and not infer_schema:
        raise ValueError("give a schema, or ask for infer_schema=True")
    reader = spark.read.option("sep", sep).option("header", header)
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not header:
        return nan_to_null(reader.schema(wanted).csv(path))
    in_file = reader.csv(path).columns
    require_columns(in_file, wanted.names)
    types = {f.name: f.dataType for f in wanted.fields}
    layout = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in in_file])
    return nan_to_null(reader.schema(layout).csv(path).select(*wanted.names))


MALFORMED = "__malformed"


@dataclass
class ReadLedger:
    """What a job that read a delimited file met; known once an action on its rows has ended."""

    columns: list[str]
    observation: Observation

    def counts(self) -> dict[str, int]:
        """Rows read, rows with too few or too many fields, and unreadable values per column."""
        seen = self.observation.get
        found = {"n_rows": seen["n_rows"], "n_malformed": seen["n_malformed"]}
        return found | {c: seen[f"c{i}"] for i, c in enumerate(self.columns)}

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(column, n_rows, n_malformed, n_unreadable)``, one row per column of the schema."""
        found = self.counts()
        rows = [(c, found["n_rows"], found["n_malformed"], found[c]) for c in self.columns]
        return spark.createDataFrame(rows, "column string, n_rows long, n_malformed long, n_unreadable long")


def read_with_ledger(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> tuple[DataFrame, ReadLedger]:
    """Read a delimited file with a header, counting what cannot be read in the very job that reads.

    A value that does not fit its type becomes NULL and is counted under its column; empty fields are NULL and
    are not counted. Rows with too few or too many fields are kept, with NULL for fields that are not there.
    Counts are of rows that the action reads, so take them after one that reads all, such as a write, and
    before any other; a retried task is not counted twice.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = spark.read.option("sep", sep).option("header", True)
    in_file = reader.csv(path).columns
    require_columns(in_file, wanted.names)
    layout = T.StructType([T.StructField(n, T.StringType()) for n in [*in_file, MALFORMED]])
    # Without this, fields that are not asked for are not even split off, and short rows go unnoticed.
    reader = reader.option("columnPruning", False)
    raw = reader.option("columnNameOfCorruptRecord", MALFORMED).schema(layout).csv(path)
    read = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in wanted.fields}
    lost = [F.count_if(F.col(f"`{n}`").isNotNull() & c.isNull()).alias(f"c{i}") for i, (n, c) in enumerate(read.items())]
    observation = Observation()
    counted = raw.observe(observation, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(MALFORMED).isNotNull()).alias("n_malformed"), *lost)
    return nan_to_null(counted.select(*[c.alias(n) for n, c in read.items()])), ReadLedger(wanted.names, observation)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Register a lazily evaluated named relation and return a reader of it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def overwrite_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rebuild a catalog table and return a reader of what was written.

    The new table is written beside the old one and takes its name once it is complete, so a job that fails
    leaves the old one as it was, and ``df`` may read the table that it replaces. A partitioned table is
    copied over instead of renamed, since partitions keep the places that they were written to.
    """
    spark = df.sparkSession
    *space, own = _name_parts(name)
    mark = uuid.uuid4().hex[:12]

    def quoted(table: str) -> str:
        return ".".join(f"`{part}`" for part in [*space, table])

    staged, old = quoted(f"{own}__new_{mark}"), quoted(f"{own}__old_{mark}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(staged)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    if partition_by:
        spark.read.table(staged).write.mode("overwrite").partitionBy(*partition_by).saveAsTable(quoted(own))
        spark.sql(f"DROP TABLE {staged}")
        return spark.read.table(quoted(own))
    replaces = spark.catalog.tableExists(quoted(own))
    if replaces:
        spark.sql(f"ALTER TABLE {quoted(own)} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {quoted(own)}")
    if replaces:
        spark.sql(f"DROP TABLE {old}")
    return spark.read.table(quoted(own))


def _name_parts(name: str) -> list[str]:
    """Parts of a table name, without their back quotes."""
    return [quoted or plain for quoted, plain in re.findall(r"`([^`]+)`|([^.`]+)", name)]


def overwrite_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def sample_input(df: DataFrame, input_cols: Sequence[str], n: int = 5) -> DataFrame:
    """A few rows of the scoring input, kept beside a model as an example."""
    return df.select(*input_cols).limit(n)


def scoring_schema(df: DataFrame, input_cols: Sequence[str], output: str = C.PREDICTION) -> dict[str, str]:
    """Input and output schema of a model as JSON text."""
    outputs = T.StructType([T.StructField(output, T.DoubleType())])
    return {"inputs": df.select(*input_cols).schema.json(), "outputs": outputs.json()}


def metrics_frame(spark: SparkSession, run_id: str, metrics: Mapping[str, float]) -> DataFrame:
    rows = [(run_id, name, float(value)) for name, value in metrics.items()]
    return spark.createDataFrame(rows, "run_id string, metric string, value double")


def params_frame(spark: SparkSession, run_id: str, params: Mapping[str, object]) -> DataFrame:
    rows = [(run_id, name, str(value)) for name, value in params.items()]
    return spark.createDataFrame(rows, "run_id string, param string, value string")


def record_run(spark: SparkSession, path: str, run_id: str, params: Mapping[str, object], metrics: Mapping[str, float]) -> None:
    """Append a run's parameters and metrics to the record tables under ``path``."""
    append_records(params_frame(spark, run_id, params), f"{path}/params")
    append_records(metrics_frame(spark, run_id, metrics), f"{path}/metrics")


def append_records(records: DataFrame, path: str) -> None:
    """Append run records; one small file per run."""
    records.coalesce(1).write.mode("append").parquet(path)


def null_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with NULL, per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
