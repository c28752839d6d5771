import numpy as np
import pytest

from aestudy.operators.deviance import d2_score, poisson_deviance

Y, MU = np.array([0.0, 1.0, 3.0, 2.0]), np.array([0.5, 1.5, 2.0, 2.0])


@pytest.fixture(scope="module")
def fits(spark):
    return spark.createDataFrame([(float(y), float(m), "a" if i < 2 else "b") for i, (y, m) in enumerate(zip(Y, MU))], "y double, mu double, g string")


def deviance(y, mu):
    return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))


def test_deviance(fits):
    assert poisson_deviance(fits, "y", "mu").first()[0] == pytest.approx(deviance(Y, MU), rel=1e-14)
    by = {r.g: r.deviance for r in poisson_deviance(fits, "y", "mu", by=["g"]).collect()}
    assert by["a"] == pytest.approx(deviance(Y[:2], MU[:2]))


def test_deviance_rejects_means_that_are_not_positive(fits):
    with pytest.raises(Exception, match="must be positive"):
        poisson_deviance(fits.withColumn("mu", fits.mu - 0.5), "y", "mu").collect()


def test_d2_is_one_minus_the_share_of_null_deviance(fits):
    expected = 1 - deviance(Y, MU) / deviance(Y, np.full(4, Y.mean()))
    assert d2_score(fits, "y", "mu").first()[0] == pytest.approx(expected, rel=1e-12)


def test_d2_of_one_row_is_null(fits):
    assert d2_score(fits.filter("y = 3"), "y", "mu").first()[0] is None
