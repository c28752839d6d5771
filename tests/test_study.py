import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.checks import cast_like, duplicate_keys, require_strings, split_schema
from aestudy.operators.study import (
    actual_to_predicted,
    aggregate_study,
    all_close,
    label_dataset,
    prediction_difference,
    select_study,
    study_cells,
    subset,
)
from aestudy.sources.tables import STUDY_SCHEMA

RAW = "Insurance_Plan string, SOA_Post_Lvl_Ind string, ExpDth_VBT2015wMI_Cnt double, Observation_Year int"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (" TERM ", "N/A", 1.0, 2017),
        ("TERM", "N/A", 2.0, 2018),
        ("TERM", "PLT", 3.0, 2017),
        ("TERM", None, 4.0, 2017),
        (None, "N/A", 5.0, 2017),
        ("TERM", "N/A", 0.0, 2017),
        ("TERM", "N/A", None, 2017),
        ("PERM", "N/A", 6.0, 2017),
        ("TERM", "N/A", 7.0, None),
    ]
    return spark.createDataFrame(rows, RAW)


def test_selection_drops_nulls_and_trims_raw_plans(raw):
    kept = sorted(r[C.EXPECTED] for r in select_study(raw).collect())
    assert kept == [1.0, 2.0, 7.0]
    assert sorted(r[C.EXPECTED] for r in select_study(raw, cleaned=True).collect()) == [2.0, 7.0]


def test_selection_on_clean_data_reaches_the_scan(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    plan = select_study(spark.read.parquet(path), cleaned=True)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for part in ("EqualTo(Insurance_Plan,TERM)", "Not(EqualTo(SOA_Post_Lvl_Ind,PLT))", "GreaterThan(ExpDth_VBT2015wMI_Cnt,0.0)"):
        assert part in pushed


def test_null_year_is_a_test_row(raw):
    labels = {r.Observation_Year: r.DATASET for r in label_dataset(raw).collect()}
    assert labels == {2017: "TRAIN", 2018: "TEST", None: "TEST"}


def test_null_keys_form_a_group_of_their_own(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 1.0), (None, 2.0, 1.0)], "k string, Death_Count double, ExpDth_VBT2015wMI_Cnt double")
    out = {r.k: (r.Death_Count, r.ExpDth_VBT2015wMI_Cnt) for r in aggregate_study(df, ["k"]).collect()}
    assert out == {"a": (1.0, 2.0), None: (3.0, 2.0)}


def test_cells_of_both_data_sets_come_from_one_aggregate(study):
    cells = study_cells(label_dataset(study), C.BOOST_KEYS)
    assert str(cells._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 1
    total = cells.agg(F.sum(C.ACTUAL)).first()[0]
    assert total == study.agg(F.sum(C.ACTUAL)).first()[0]
    assert subset(cells, C.TRAIN).count() + subset(cells, C.TEST).count() == cells.count()


def test_ratios_name_their_direction_and_survive_zero(spark):
    df = spark.createDataFrame([("a", 2.0, 4.0), ("b", 3.0, 0.0)], "k string, Death_Count double, ExpDth_VBT2015wMI_Cnt double")
    out = {r.k: (r.actual_over_predicted, r.predicted_over_actual) for r in actual_to_predicted(df, by=["k"]).collect()}
    assert out == {"a": (0.5, 2.0), "b": (None, 0.0)}


def test_missing_and_wrong_columns_raise(study):
    with pytest.raises(ValueError, match="No_Such"):
        aggregate_study(study, ["No_Such"])
    with pytest.raises(TypeError, match="Attained_Age"):
        require_strings(study, ["Sex", "Attained_Age"])
    with pytest.raises(ValueError):
        split_schema(study, ["nothing"])


def test_schema_split_keeps_schema_order(study):
    split = split_schema(study, [C.ACTUAL, C.EXPECTED])
    assert split.strings == ["Sex", "Smoker_Status", "Face_Amount_Band"]
    assert split.numbers == ["Observation_Year", "Issue_Year", "Issue_Age", "Attained_Age"]


def test_cast_like_turns_misfits_into_null(spark):
    df = spark.createDataFrame([("12", "x"), ("old", "y")], "Attained_Age string, other string")
    assert [r.Attained_Age for r in cast_like(df, STUDY_SCHEMA).collect()] == [12, None]


def test_closeness_checks(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-12), (2.0, 2.0)], "a double, b double")
    assert all_close(df, "a", "b", 1e-10, 1e-10)
    assert not all_close(df.withColumn("b", F.col("b") + 1e-6), "a", "b", 1e-10, 1e-10)
    with_null = df.unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    assert not all_close(with_null, "a", "b", 1, 1)
    assert prediction_difference(with_null, "a", "b").first()["n_missing"] == 1


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [tuple(r) for r in duplicate_keys(df, ["k"]).collect()] == [("a", 2)]


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A third of all rows share one key: the map side sends one row per task and key."""
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
        "CAST(id % 2 AS DOUBLE) AS Death_Count",
        "CAST(1 AS DOUBLE) AS ExpDth_VBT2015wMI_Cnt",
    )
    out = aggregate_study(df, ["k"])
    assert str(out._jdf.queryExecution().executedPlan()).count("partial_sum") >= 1
    assert out.filter("k = 'hot'").first()["ExpDth_VBT2015wMI_Cnt"] == 10_000
