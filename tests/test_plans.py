import pandas as pd
import pytest
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.boost import BoostModel
from aestudy.operators.design import Cat, Num, Spline, cross, fit_design
from aestudy.operators.encode import study_encoding
from aestudy.operators.glm import fit_glm_path
from aestudy.operators.score import score_with_udf, scoring_udf
from aestudy.operators.splits import SplitRules
from aestudy.operators.study import label_dataset, select_study
from aestudy.operators.tree import Node, Tree
from aestudy.plans.dataset import build_dataset
from aestudy.plans.scoring import post_score_check, run_scoring, score_rows
from aestudy.plans.training import train_boost_study, train_glm_study
from aestudy.sources import models
from aestudy.sources.checkpoints import ensure_checkpoint_dir
from aestudy.sources.models import load_model, save_model
from aestudy.sources.tables import (
    overwrite_table,
    STUDY_SCHEMA,
    append_records,
    metrics_frame,
    params_frame,
    publish_view,
    read_delimited,
    read_parquet,
    read_with_ledger,
    sample_input,
    scoring_schema,
)

TEXT = """Extra\tInsurance_Plan\tSOA_Post_Lvl_Ind\tObservation_Year\tIssue_Year\tIssue_Age\tAttained_Age\tSex\tSmoker_Status\tFace_Amount_Band\tDeath_Count\tExpDth_VBT2015wMI_Cnt
1\t Term\tN/A\t2015\t1975\t30\t70\tm \tns\t05: 100,000 - 249,999\t1\t0.5
2\tperm\tplt\t2018\t2010\t40\t48\tF\tS\t11: 10,000,000+\t0\tNaN
3\tTERM\t\t\t\t40\t48\tF\tS\t11: 10,000,000+\t0\t0.25
"""


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("source") / "study.txt"
    path.write_text(TEXT)
    return str(path)


@pytest.fixture(scope="module")
def labelled(study):
    rows = study.withColumn(C.PLAN, F.lit("TERM")).withColumn(C.POST_LEVEL, F.lit("N/A"))
    return label_dataset(rows)


@pytest.fixture(scope="module")
def glm(study):
    terms = [*cross(Spline("Attained_Age"), Cat("Sex", "M")), (Num("Issue_Age"),)]
    return fit_glm_path(study, fit_design(study, terms), [1e-1, 1e-3])


def test_source_file_to_study_table(spark, source):
    out = build_dataset(spark, source, table="study_table")
    assert out.columns == [*STUDY_SCHEMA.names, C.ISSUE_YEAR_GROUP]
    first, second, third = out.orderBy("Death_Count", "Issue_Year", ascending=[False, False]).collect()
    assert (first.Insurance_Plan, first.Sex, first.Smoker_Status, first.Issue_Year_Group) == ("TERM", "M", "NS", "≤1980")
    assert (second.SOA_Post_Lvl_Ind, second.ExpDth_VBT2015wMI_Cnt, second.Issue_Year_Group) == ("PLT", None, "2009+")
    assert (third.Issue_Year, third.Issue_Year_Group) == (None, "Unknown")
    assert spark.read.table("study_table").count() == 3


def test_reading_delimited_files(spark, source):
    with pytest.raises(ValueError, match="infer_schema"):
        read_delimited(spark, source)
    inferred = read_delimited(spark, source, infer_schema=True)
    assert inferred.schema["Extra"].dataType.typeName() == "integer"
    with pytest.raises(ValueError, match="No_Such"):
        read_delimited(spark, source, schema="No_Such int")
    assert read_delimited(spark, source, schema="Issue_Age int, Extra int").columns == ["Issue_Age", "Extra"]


@pytest.mark.parametrize("kind", ["glm", "boost"])
def test_saved_models_predict_the_same(spark, study, glm, tmp_path, kind):
    tree = Tree([Node(0, 0, "Attained_Age", 50.5, 1, 2, 1, source="Attained_Age"), Node(1, 1, leaf=0.2), Node(2, 1, leaf=-0.1)])
    model = glm if kind == "glm" else BoostModel(study_encoding(), [tree, tree], 1, [0.5, 0.25])
    save_model(spark, model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    assert loaded.input_cols == model.input_cols
    both = loaded.predict(model.predict(study, output="before"), output="after")
    assert both.filter("before <> after OR before IS NULL OR after IS NULL").count() == 0
    if kind == "glm":
        assert loaded.by_name(0) == glm.by_name(0) and loaded.n_rows == glm.n_rows
    else:
        assert loaded.trees == model.trees and loaded.history == [0.5, 0.25]


def test_a_save_that_is_cut_off_leaves_the_old_model(spark, study, glm, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="no model"):
        load_model(spark, path)
    tree = Tree([Node(0, 0, leaf=0.2)])
    save_model(spark, BoostModel(study_encoding(), [tree], 0), path)

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(models, "scoring_schema", fail)
    with pytest.raises(RuntimeError):
        save_model(spark, glm, path, study)
    assert isinstance(load_model(spark, path), BoostModel)
    monkeypatch.undo()
    save_model(spark, glm, path, study)
    assert load_model(spark, path).input_cols == glm.input_cols and load_model(spark, path).by_name(0) == glm.by_name(0)


def test_a_failed_job_leaves_the_old_table(spark):
    overwrite_table(spark.range(5).toDF("x"), "replaced")
    broken = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        overwrite_table(broken, "replaced")
    assert spark.table("replaced").count() == 5
    assert overwrite_table(spark.table("replaced").select((F.col("x") + 1).alias("y")), "replaced").agg(F.sum("y")).first()[0] == 15
    assert overwrite_table(spark.range(3).selectExpr("id AS y", "id % 2 AS p"), "replaced", ["p"]).where("p = 1").count() == 1
    assert [t.name for t in spark.catalog.listTables() if "replaced" in t.name] == ["replaced"]


def test_batch_scoring(spark, labelled, glm, tmp_path):
    labelled.drop(C.DATASET).write.mode("overwrite").saveAsTable("scoring_input")
    save_model(spark, glm, str(tmp_path / "model"))
    run = run_scoring(spark, str(tmp_path / "model"), "scoring_input", "scoring_output", alpha_index=0)
    written = spark.read.table("scoring_output")
    assert written.columns == [*labelled.columns, C.PREDICTION]
    direct = score_rows(select_study(labelled), glm, alpha_index=0)
    assert run.totals["predicted"] == pytest.approx(post_score_check(direct).first()["predicted"])
    assert run.totals["actual_over_predicted"] * run.totals["predicted_over_actual"] == pytest.approx(1.0)
    again = run_scoring(spark, str(tmp_path / "model"), "scoring_input", "scoring_output", alpha_index=0)
    assert again.totals["n_rows"] == run.totals["n_rows"] == labelled.count()
    for same in ("scoring_input", "SCORING_INPUT", "default.scoring_input", "`spark_catalog`.default.`scoring_input`"):
        with pytest.raises(ValueError, match="must not be"):
            run_scoring(spark, str(tmp_path / "model"), "scoring_input", same)


def test_training_runs_leave_records(spark, labelled, tmp_path):
    path = str(tmp_path / "records")
    train_glm_study(labelled, alphas=[1e-1, 1e-3], alpha_index=1, records=path).close()
    train_boost_study(labelled, records=path, run_id="b", max_rounds=1, learning_rate=0.3)
    params = {(r.run_id, r.param): r.value for r in spark.read.parquet(f"{path}/params").collect()}
    metrics = {(r.run_id, r.metric): r.value for r in spark.read.parquet(f"{path}/metrics").collect()}
    assert params["glm", "alpha"] == "0.001" and params["b", "max_rounds"] == "1" and "Sex" in params["b", "inputs"]
    assert metrics["glm", "predicted_over_actual"] == pytest.approx(1.0, abs=1e-9) and metrics["b", "best_iteration"] == 0


def test_schema_and_sample_travel_with_a_model(spark, study, glm, tmp_path):
    path = save_model(spark, glm, str(tmp_path / "described"), study)
    roles = {r.role: r.schema for r in spark.read.parquet(f"{path}/schema").collect()}
    assert set(roles) == {"inputs", "outputs"} and "Attained_Age" in roles["inputs"]
    assert spark.read.parquet(f"{path}/sample").columns == glm.input_cols


def test_glm_training_run(labelled):
    run = train_glm_study(labelled, alphas=[1e-1, 1e-3])
    assert run.predicted_over_actual == pytest.approx(1.0, abs=1e-9)
    scores = {r.alpha_index: r.d2 for r in run.test_stats.collect()}
    assert run.alpha_index == max(scores, key=lambda i: (scores[i], -i))
    assert run.train_splits.count() == len(run.train_tree.splits)
    root = run.train_splits.first()
    assert root.sum_exp_parent == pytest.approx(root.sum_y_parent)
    assert set(run.factor_tables) == {"intercept", "Attained_Age_x_Smoker_Status_x_Sex", "Face_Amount_Band"}
    run.close()


def test_boost_training_run(labelled):
    model, ratio = train_boost_study(labelled, max_rounds=2, learning_rate=0.3, rules=SplitRules(gamma=0.0))
    assert len(model.trees) == 2 and 0.3 < ratio < 3


def test_scoring_udf_sees_a_frame(study):
    def predict(rows: pd.DataFrame) -> pd.Series:
        return rows["Attained_Age"] * 2.0 + (rows["Sex"] == "F")

    scored = score_with_udf(study, scoring_udf(predict), ["Sex", "Attained_Age"])
    native = F.col("Attained_Age") * 2.0 + (F.col("Sex") == "F").cast("double")
    assert scored.filter(F.col(C.PREDICTION) != native).count() == 0


def test_scoring_schema_and_sample(study):
    schema = scoring_schema(study, ["Sex", "Attained_Age"])
    assert '"Attained_Age"' in schema["inputs"] and "prediction" in schema["outputs"]
    assert sample_input(study, ["Sex"]).count() == 5


def test_run_records_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    append_records(metrics_frame(spark, "a", {"ae": 1.5}), path)
    append_records(metrics_frame(spark, "b", {"ae": 0.5, "rounds": 3}), path)
    assert sorted(tuple(r) for r in read_parquet(spark, path).collect()) == [("a", "ae", 1.5), ("b", "ae", 0.5), ("b", "rounds", 3.0)]
    assert params_frame(spark, "a", {"depth": 3}).first()["value"] == "3"


def test_published_view_is_lazy_and_named(spark, study):
    view = publish_view(study.filter("Sex = 'F'"), "women")
    assert view.count() == spark.sql("SELECT count(*) FROM women").first()[0] == study.filter("Sex = 'F'").count()


def test_checkpoints_go_to_the_named_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)


def test_stateless_operators_run_on_a_stream(spark, labelled, glm, tmp_path):
    """Cleaning, selection, labelling and scoring are plain projections and filters."""
    labelled.drop(C.DATASET).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(labelled.drop(C.DATASET).schema).parquet(str(tmp_path / "in"))
    scored = glm.predict(label_dataset(select_study(rows)))
    query = (
        scored.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    batch = glm.predict(labelled).agg(F.sum(C.PREDICTION)).first()[0]
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum(C.PREDICTION)).first()[0] == pytest.approx(batch)


def test_ledger_counts_broken_values_and_rows(spark, tmp_path):
    path = tmp_path / "broken.txt"
    path.write_text("a\tb\tc\n1\tx\t1.5\none\ty\t\n3\tz\n4\tw\t2.5\textra\n\tv\tNaN\n")
    rows, ledger = read_with_ledger(spark, str(path), "c double, a int")
    rows.write.parquet(str(tmp_path / "copy"))
    assert ledger.counts() == {"n_rows": 5, "n_malformed": 2, "c": 0, "a": 1}
    copied = sorted(map(tuple, spark.read.parquet(str(tmp_path / "copy")).collect()), key=repr)
    assert copied == sorted([(1.5, 1), (None, None), (None, 3), (2.5, 4), (None, None)], key=repr)
    with pytest.raises(ValueError):
        read_with_ledger(spark, str(path), "none_such int")
