import numpy as np
import pytest

from aestudy.functions.spline import basis_columns

KNOTS = [18.0, 41.0, 67.5, 90.0]


@pytest.fixture(scope="module")
def basis(spark):
    """Basis at a fine grid that runs over both bounds."""

    def at(values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
        rows = df.select("i", *basis_columns(df.x, KNOTS)).orderBy("i").collect()
        return np.array([list(r)[1:] for r in rows])

    return at


def test_identity_at_knots(basis):
    assert basis(KNOTS) == pytest.approx(np.eye(4), abs=1e-14)


def test_rows_sum_to_one_and_reproduce_x(basis):
    x = np.linspace(5, 110, 211)
    b = basis(x)
    assert b.sum(axis=1) == pytest.approx(np.ones(len(x)), abs=1e-12)
    assert b @ np.array(KNOTS) == pytest.approx(x, abs=1e-10)


def test_first_and_second_derivatives_meet_at_every_knot(basis):
    e = 1e-3
    for k in KNOTS:
        b = basis([k - 2 * e, k - e, k, k + e, k + 2 * e])
        left, right = (b[2] - b[1]) / e, (b[3] - b[2]) / e
        assert left == pytest.approx(right, abs=1e-4)
        curve_left, curve_right = (b[0] - 2 * b[1] + b[2]) / e**2, (b[2] - 2 * b[3] + b[4]) / e**2
        assert curve_left == pytest.approx(curve_right, abs=1e-3)


def test_linear_outside_the_bounds(basis):
    for x in ([0.0, 5.0, 10.0], [95.0, 100.0, 105.0]):
        b = basis(x)
        assert b[2] - b[1] == pytest.approx(b[1] - b[0], abs=1e-12)


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert list(df.select(*basis_columns(df.x, KNOTS)).first()) == [None] * 4
