import numpy as np
import pytest
from pyspark.sql import types as T

from aestudy.operators.checks import cast_failures
from aestudy.operators.encode import encode, learned_levels, one_hot, ordinal, study_encoding
from aestudy.operators.grid import grid_axes, prediction_grid
from aestudy.operators.values import baseline_levels, collect_levels, distinct_quantiles, first_values, value_range


@pytest.fixture(scope="module")
def skewed(spark):
    """Values crowd near zero, a third of the rows repeat one value, and one value lies far out."""
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.exponential(1.0, 3000) ** 4] + [0.25] * 1500 + [1e6]
    return spark.createDataFrame([(v,) for v in values], "x double"), np.unique(values)


def test_quantiles_of_distinct_values_are_exact(skewed):
    df, distinct = skewed
    probabilities = [0.0, 0.2, 1 / 3, 0.5, 0.999, 1.0]
    found = distinct_quantiles(df, "x", probabilities, 0.0, 2e6)
    assert found == pytest.approx(np.quantile(distinct, probabilities), rel=1e-12)


def test_quantiles_respect_bounds(skewed):
    df, distinct = skewed
    inside = distinct[(distinct >= 0.5) & (distinct <= 2.0)]
    assert distinct_quantiles(df, "x", [0.5], 0.5, 2.0) == pytest.approx([np.quantile(inside, 0.5)])
    with pytest.raises(ValueError, match="no value"):
        distinct_quantiles(df, "x", [0.5], -2.0, -1.0)


def test_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    assert collect_levels(df, "v") == ["a", "b", "c"]
    assert baseline_levels(df, "v", "c") == ["c", "a", "b"]
    assert learned_levels(df, "v") == ["a", "b", "c", None]
    assert first_values(df, ["v"]).first().v == "a"
    with pytest.raises(ValueError, match="more than 2 levels"):
        collect_levels(df, "v", max_levels=2)


def test_range_includes_unseen_values(spark):
    df = spark.createDataFrame([(3,), (6,), (None,)], "a int")
    assert [r.a for r in value_range(df, "a").orderBy("a").collect()] == [3, 4, 5, 6]


def test_one_hot_of_unknown_and_null_is_zero(spark):
    df = spark.createDataFrame([("M",), ("F",), ("?",), (None,)], "Sex string")
    assert [r.Sex_F for r in one_hot(df, "Sex", ["M", "F"]).collect()] == [0.0, 1.0, 0.0, 0.0]


def test_ordinal_of_unknown_and_null_is_minus_one(spark):
    df = spark.createDataFrame([("lo",), ("hi",), ("?",), (None,)], "v string")
    assert [r.c for r in df.select(ordinal("v", ["lo", "hi"]).alias("c")).collect()] == [0.0, 1.0, -1.0, -1.0]


def test_study_encoding_names(study):
    out = encode(study, study_encoding())
    assert out.columns == ["Sex_F", "Smoker_Status_S", "Smoker_Status_U", "Face_Amount_Band", "Attained_Age"]
    assert {r.Face_Amount_Band for r in out.collect()} == {0.0, 1.0, 4.0}


def test_grid_is_the_whole_product_without_a_join(spark):
    df = spark.createDataFrame([("x", 2, "p"), ("y", 4, None)], "a string, n int, b string")
    axes = grid_axes(df, ["a", "n", "b"])
    grid = prediction_grid(spark, list(axes.values()))
    assert [tuple(r) for r in grid.collect()] == [(a, n, "p") for a in "xy" for n in (2, 3, 4)]
    assert "Join" not in str(grid._jdf.queryExecution().executedPlan())
    assert grid.schema["n"].dataType == df.schema["n"].dataType
    with pytest.raises(ValueError, match="6 rows"):
        prediction_grid(spark, list(axes.values()), max_rows=5)


def test_null_and_a_level_called_none_are_told_apart(spark):
    df = spark.createDataFrame([("None",), (None,), ("a",)], "v string")
    out = one_hot(df, "v", learned_levels(df, "v"), drop_first=False).collect()
    assert [(r.v_None, r["v_None_"], r.v_a) for r in out] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_wide_columns_have_no_limit(spark):
    df = spark.range(12_000).selectExpr("CAST(id AS STRING) AS v")
    assert len(collect_levels(df, "v")) == 12_000


def test_values_lost_in_a_cast_are_counted(spark):
    df = spark.createDataFrame([("1", "x"), ("one", "y"), (None, "z")], "a string, b string")
    lost = cast_failures(df, T.StructType([T.StructField("a", T.IntegerType())])).first()
    assert (lost.n_rows, lost.a) == (3, 1)
