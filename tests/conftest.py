import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("aestudy-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


STUDY_DDL = (
    "Observation_Year int, Issue_Year int, Issue_Age int, Sex string, Smoker_Status string, "
    "Attained_Age int, Face_Amount_Band string, Death_Count double, ExpDth_VBT2015wMI_Cnt double"
)


def study_rows(n=600, seed=3):
    """Rows with a known effect of age, sex and smoker status."""
    rng = np.random.default_rng(seed)
    bands = ["01: 0 - 9,999", "02: 10,000 - 24,999", "05: 100,000 - 249,999"]
    rows = []
    for _ in range(n):
        age = int(rng.integers(15, 96))
        sex, smoker, band = rng.choice(["M", "F"]), rng.choice(["NS", "S", "U"]), rng.choice(bands)
        expected = float(rng.integers(1, 40)) / 4
        rate = np.exp(0.01 * (age - 50) + 0.3 * (smoker == "S") - 0.2 * (sex == "F"))
        year = int(rng.integers(2012, 2020))
        rows.append((year, int(rng.integers(1975, 2015)), age - 5, str(sex), str(smoker), age, str(band), float(rng.poisson(expected * rate)), expected))
    return rows


@pytest.fixture(scope="session")
def study(spark):
    df = spark.createDataFrame(study_rows(), STUDY_DDL).cache()
    df.count()
    return df
