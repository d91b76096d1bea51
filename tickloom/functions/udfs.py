"""The few functions Spark has no expression for, as Arrow-batched UDFs and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def exact_round(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, halves to even, as Python rounds; Spark's own round goes by the decimal text."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: round(v, digits), na_action="ignore").astype("float64")

    return run(c.cast("double"))


class GridAxis:
    """Rows (position, value) from low to high in steps, both ends included, free of accumulated error."""

    def eval(self, low: float, high: float, step: float) -> Iterator[tuple[int, float]]:
        if low is None or high is None or step is None or not step > 0:
            return
        n = int((high - low) / step + 1e-9)
        for i in range(n + 1):
            yield i, round(low + i * step, 9)


def register(spark: SparkSession) -> None:
    """Makes ``grid_axis(low, high, step)`` known to SQL."""
    spark.udtf.register("grid_axis", F.udtf(GridAxis, returnType="position int, value double"))
