"""A study over the order tables: shipped quantity is the expected count, a return the actual one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.design import Cat, Spline, Term, cross
from aestudy.operators.encode import EncodedColumn, number_column, one_hot_columns, ordinal_column
from aestudy.operators.study import label_dataset, select_study, study_cells, subset

PLAN_KEPT = "BUILDING"
LEVEL_EXCLUDED = "PROMO"
TRAIN_UNTIL = 1999
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study row per order line.

    Orders meet their customers first, so a filter on the plan thins them out before the lines are
    joined. Join strategy is left to Catalyst: sizes decide on broadcasts, and adaptive execution
    splits hot keys of the shuffled joins.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.year("l_shipdate").alias(C.OBSERVATION_YEAR),
        F.col("l_linestatus").alias(C.SEX),
        F.col("l_quantity").alias(C.EXPECTED),
        (F.col("l_returnflag") == "R").cast("double").alias(C.ACTUAL),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.year("o_orderdate").alias(C.ISSUE_YEAR),
        F.col("o_orderstatus").alias(C.SMOKER),
        F.col("o_orderpriority").alias(C.FACE_BAND),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias(C.PLAN))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias(C.POST_LEVEL), F.col("p_size").alias(C.ISSUE_AGE)
    )
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            C.PLAN,
            C.POST_LEVEL,
            C.OBSERVATION_YEAR,
            C.ISSUE_YEAR,
            C.ISSUE_AGE,
            F.col(C.ISSUE_AGE).alias(C.ATTAINED_AGE),
            C.SEX,
            C.SMOKER,
            C.FACE_BAND,
            C.ACTUAL,
            C.EXPECTED,
        )
    )


def selected_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered and labelled study; the tables' strings are clean already."""
    rows = select_study(study_base(spark, sf_dir), PLAN_KEPT, LEVEL_EXCLUDED, cleaned=True)
    return label_dataset(rows, last_train_year=TRAIN_UNTIL)


def cells(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return study_cells(selected_study(spark, sf_dir), keys)


def train_cells(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return subset(cells(spark, sf_dir, keys), C.TRAIN).drop(C.DATASET)


def age_spline() -> Spline:
    return Spline(C.ATTAINED_AGE, df=4, lower=5, upper=45)


def order_terms() -> list[Term]:
    sex, smoker, band = Cat(C.SEX, "O"), Cat(C.SMOKER, "F"), Cat(C.FACE_BAND, "3-MEDIUM")
    return [*cross(age_spline(), smoker, sex), (band,)]


def order_encoding() -> list[EncodedColumn]:
    return [
        *one_hot_columns(C.SEX, ["O", "F"]),
        *one_hot_columns(C.SMOKER, ["F", "O", "P"]),
        ordinal_column(C.FACE_BAND, PRIORITIES),
        number_column(C.ATTAINED_AGE),
    ]
