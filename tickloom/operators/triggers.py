"""First-trigger replays of trailing orders as window queries.

The rows of one replay are those of its symbol within a horizon after its start; a running minimum or maximum is
the trail, and the trigger is the first row that crosses it. Nothing is folded in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import forward_range


def paths(starts: DataFrame, prices: DataFrame, horizon_us: int) -> DataFrame:
    """The price rows (t, price, tick_id) of each start's symbol e within the horizon after it."""
    return forward_range(starts, prices, ["e"], horizon_us)


def first_buy(path: DataFrame, trail_pct: str) -> DataFrame:
    """Per id: the first row whose price is at or above the running low times (1 + trail), the low itself included from
    the start on. Columns id, triggered, trigger_t, trigger_price, low; without a trigger the replay is right-censored."""
    w = Window.partitionBy("id").orderBy("t", "tick_id")
    d = path.withColumn("low", F.min("price").over(w)).withColumn("hit", F.col("price") >= F.col("low") * (1 + F.col(trail_pct) / 100))
    first = F.min(F.when(F.col("hit") & (F.col("price") > F.col("low")), F.struct("t", "tick_id", "price", "low")))
    return d.groupBy("id").agg(first.alias("x")).select("id", F.col("x").isNotNull().alias("triggered"), F.col("x.t").alias("trigger_t"), F.col("x.price").alias("trigger_price"), F.col("x.low").alias("low"))


def first_sell(path: DataFrame, required: str, trail_pct: str) -> DataFrame:
    """Per id: activation is the first row with price at or above ``required``; from it on the running high trails, and the
    trigger is the first later row at or below high * (1 - trail)."""
    w = Window.partitionBy("id").orderBy("t", "tick_id")
    d = path.withColumn("_on", F.max(F.when(F.col("price") >= F.col(required), 1).otherwise(0)).over(w)).where("_on = 1")
    d = d.withColumns({"n": F.row_number().over(w), "high": F.max("price").over(w)})
    hit = (F.col("n") > 1) & (F.col("price") <= F.col("high") * (1 - F.col(trail_pct) / 100))
    g = d.groupBy("id").agg(F.min(F.struct("t", "tick_id")).alias("a"), F.min(F.when(hit, F.struct("t", "tick_id", "price", "high"))).alias("x"))
    return g.select("id", F.col("a.t").alias("activation_t"), F.col("x").isNotNull().alias("triggered"), F.col("x.t").alias("trigger_t"), F.col("x.price").alias("trigger_price"), F.col("x.high").alias("high"))


def excursions(path: DataFrame, triggers: DataFrame) -> DataFrame:
    """Per id: largest favourable and adverse move, in basis points of the trigger price, from a buy trigger on."""
    j = path.join(triggers.where("triggered").select("id", "trigger_t", "trigger_price"), "id").where("t >= trigger_t")
    move = (F.col("price") / F.col("trigger_price") - 1) * 10000
    return j.groupBy("id").agg(F.greatest(F.max(move), F.lit(0.0)).alias("mfe_bps"), F.greatest(-F.min(move), F.lit(0.0)).alias("mae_bps"))
