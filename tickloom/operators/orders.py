"""Orders from fills: deduplication, grouping, allocation, percentiles and cross-fitted costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import iso_micros


def fills_once(executions: DataFrame) -> DataFrame:
    """Each fill once, as one of its rows: the one with the largest commission, then the latest; with e (symbol), t (epoch
    microseconds), day and notional. Fills with a null id are left out."""
    t = iso_micros(F.col("executed_at"))
    row = F.struct("cycle_id", F.upper(F.trim("ticker")).alias("e"), "order_ref", "side", "shares", "price", "commission", t.alias("t"))
    text = [F.coalesce(c, F.lit("")) for c in ("executed_at", "ticker", "order_ref", "cycle_id")]
    order = F.struct(F.coalesce("commission", F.lit(-1e300)), F.coalesce(t, F.lit(0)), *text)
    x = executions.where("id is not null").groupBy("id").agg(F.max_by(row, order).alias("x")).select("id", "x.*")
    return x.withColumns({"day": F.to_date(F.timestamp_micros("t")), "notional": F.col("shares") * F.col("price")})


def by_order(fills: DataFrame) -> DataFrame:
    """Per cycle, side and order: fills, quantity, notional, VWAP, commission, first and last time. A fill without a
    reference belongs to its cycle and side."""
    ref = F.coalesce(F.nullif(F.trim("order_ref"), F.lit("")), F.concat_ws("/", "cycle_id", "side")).alias("order_key")
    return fills.groupBy("cycle_id", "side", ref).agg(
        F.count(F.lit(1)).alias("fills"), F.sum("shares").alias("quantity"), F.sum("notional").alias("notional"), F.sum("commission").alias("commission"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    ).withColumn("vwap", F.try_divide("notional", "quantity"))


def allocate(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """Shares a cycle's total (cycle_id, side, total) among its orders by notional; without a total their own commission stays."""
    w = Window.partitionBy("cycle_id", "side")
    j = orders.withColumn("_all", F.sum("notional").over(w)).join(totals, ["cycle_id", "side"], "left")
    return j.withColumn("allocated", F.when(F.col("total") > 0, F.col("total") * F.try_divide("notional", "_all")).otherwise(F.col("commission"))).drop("_all", "total")


def cost_percentiles(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per group the count and the 50th, 75th and 90th percentile (linear interpolation)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, (0.5, 0.75, 0.9)))).alias("_p")).select(*keys, "n", *[F.col("_p")[i].alias(c) for i, c in enumerate(("p50", "p75", "p90"))])


def cross_fitted(days: DataFrame, minimum: int, default: float) -> DataFrame:
    """Per (key, day): the cost to assume on that day from the other days alone. ``days`` has key, day, n and cost.

    With at least ``minimum`` samples before the day their weighted mean holds, else the mean of all other days, drawn
    towards ``default`` by n / minimum; never below the default. Running and total sums, so no self-join.
    """
    w = Window.partitionBy("key").orderBy("day")
    before, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    d = days.withColumn("_s", F.col("n") * F.col("cost"))
    d = d.withColumns({"_pn": F.coalesce(F.sum("n").over(before), F.lit(0)), "_ps": F.coalesce(F.sum("_s").over(before), F.lit(0.0)), "_on": F.sum("n").over(every) - F.col("n"), "_os": F.sum("_s").over(every) - F.col("_s")})
    prior = F.when(F.col("_pn") >= minimum, F.try_divide("_ps", "_pn"))
    rest = F.try_divide("_os", "_on")
    weight = F.least(F.lit(1.0), F.col("_on") / minimum)
    est = F.coalesce(prior, F.lit(default) + weight * (rest - default), F.lit(default))
    return d.select("key", "day", "n", F.greatest(est, F.lit(default)).alias("assumed"))
