"""Backward as-of and range joins with a tolerance.

Time is cut into slices at least as long as the tolerance. A right record goes to its own slice and, if its reach
crosses the border, to the next: at most two copies. All joining then happens within (key, slice), so a key with
any share of the rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _slices(t: F.Column, reach: int, width: int) -> F.Column:
    a, b = F.floor(t / width), F.floor((t + reach) / width)
    return F.explode(F.when(a == b, F.array(a)).otherwise(F.array(a, b)))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str], tolerance_us: int, slice_us: int = 600_000_000) -> DataFrame:
    """Adds to each left row ``m``: a struct (t, o, payload) of the latest right row with t at most the left one's and at
    most ``tolerance_us`` older, else null. Both sides have t (epoch microseconds); of one instant the right row of the
    largest ``o`` counts. Left rows with a null key or t get no match. One shuffle of the union; the right side goes last."""
    width = max(slice_us, tolerance_us)
    cols = left.columns
    r = right.where("t is not null").select(*keys, F.struct("t", "o", *payload).alias("_r"), F.col("t").alias("_t"), F.lit(0).alias("_side"), _slices(F.col("t"), tolerance_us, width).alias("_slice"), F.col("o").alias("_o"))
    a = left.select(*keys, F.struct(*cols).alias("_l"), F.col("t").alias("_t"), F.lit(1).alias("_side"), F.floor(F.col("t") / width).alias("_slice"))
    u = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    j = u.withColumn("m", F.last("_r", True).over(w)).where("_side = 1")
    known = " and ".join(f"_l.{k} is not null" for k in keys)
    return j.select("_l.*", F.when(F.expr(known) & (F.col("_t") - F.col("m.t") <= tolerance_us), F.col("m")).alias("m"))


def forward_range(left: DataFrame, right: DataFrame, keys: list[str], reach_us: int, slice_us: int = 600_000_000) -> DataFrame:
    """Pairs (left columns, right columns) with the right t in (left t, left t + reach_us]; both have t. Left rows go to the
    one or two slices they reach, right rows to their own, so the join is an equi-join with a range check."""
    width = max(slice_us, reach_us)
    a = left.withColumn("_slice", _slices(F.col("t"), reach_us, width)).withColumnRenamed("t", "left_t")
    b = right.withColumn("_slice", F.floor(F.col("t") / width))
    return a.join(b, [*keys, "_slice"]).where(f"t > left_t and t <= left_t + {reach_us}").drop("_slice")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], slice_us: int = 3_600_000_000) -> DataFrame:
    """Pairs of points (t) and intervals (lo, hi; epoch microseconds, lo <= t < hi) with equal keys. Intervals are cut into
    slices, so the range check runs inside an equi-join."""
    i = intervals.where("lo < hi").withColumn("_slice", F.explode(F.sequence(F.floor(F.col("lo") / slice_us), F.floor((F.col("hi") - 1) / slice_us))))
    p = points.withColumn("_slice", F.floor(F.col("t") / slice_us))
    return p.join(i, [*keys, "_slice"]).where("t >= lo and t < hi").drop("_slice")
