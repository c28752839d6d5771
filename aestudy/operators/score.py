"""Scoring rows with a model: native expressions, or a Python function over a struct."""

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aestudy import columns as C
from aestudy.operators.checks import require_columns


def pack(input_cols: Iterable[str]) -> Column:
    return F.struct(*input_cols)


def scoring_udf(predict: Callable[[pd.DataFrame], pd.Series]):
    """Wrap a batch function as a UDF over a struct; it sees one pandas frame per Arrow batch.

    Models of this package are scored natively; this is the way in for any other model.
    """

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(rows)).astype("float64")

    return score


def score_with_udf(df: DataFrame, udf, input_cols: Sequence[str], output: str = C.PREDICTION) -> DataFrame:
    require_columns(df.columns, input_cols)
    return df.withColumn(output, udf(pack(input_cols)))
