"""Where iterative jobs cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a folder in the warehouse is used, which all executors share as well.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Has Spark remove the shuffle files of a job when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Estimated bytes beyond which Spark deals out the sides of a join that lie in one partition each.
SINGLE_BYTES = "spark.sql.maxSinglePartitionBytes"


def cut_lineage(df: DataFrame, free: bool = False, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    ``free``: its shuffle files go at once, for long chains of steps that nothing comes back to.
    ``few``: what lies in one partition is joined there, for rows that are counted to be few; Spark
    estimates checkpoints by the plans that made them, so that chains of joins look endless.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not free and not few:
        return df.checkpoint(eager=True)
    wanted = {FREE_SHUFFLES: "true"} if free else {}
    if few:
        wanted[SINGLE_BYTES] = str((1 << 63) - 1)
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return df.select("*").checkpoint(eager=True)  # the settings hold for frames made under them
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files, in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
