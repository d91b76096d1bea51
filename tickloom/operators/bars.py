"""Bars and average true range, on the wall clock and on a recording's monotonic clock, by windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlc(t: DataFrame, bar_seconds: int) -> DataFrame:
    """(session_id, bar, open, high, low, close, readings) per tumbling wall-clock bar; map-side combined."""
    at = F.struct("captured_at_utc", "tick_id")
    bar = (F.floor(F.unix_micros("captured_at_utc") / (bar_seconds * 1_000_000)) * bar_seconds).alias("bar")
    return t.where("price is not null").groupBy("session_id", bar).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("readings")
    )


def true_range(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds prev_close and tr."""
    b = bars.withColumn("prev_close", F.lag("close").over(Window.partitionBy(*keys).orderBy(order)))
    return b.withColumn("tr", F.when(F.col("prev_close").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))))


def bar_atr(bars: DataFrame, period: int) -> DataFrame:
    """Adds atr and atr_pct after each bar: the mean of the last ``period`` true ranges, null until there are that many."""
    w = Window.partitionBy("session_id").orderBy("bar").rowsBetween(1 - period, 0)
    b = true_range(bars, ["session_id"], "bar")
    b = b.withColumns({"atr": F.when(F.count("tr").over(w) == period, F.avg("tr").over(w))})
    return b.withColumn("atr_pct", F.when(F.col("atr") > 0, F.col("atr") / F.col("close") * 100))


def latest(bars: DataFrame) -> DataFrame:
    """Each session's last bar with its ATR, and the session's rank by ATR% (ties: session_id)."""
    last = bars.where("atr_pct is not null").groupBy("session_id").agg(F.max_by(F.struct("bar", "close", "atr", "atr_pct"), "bar").alias("x")).select("session_id", "x.*")
    return ranked(last, -F.round("atr_pct", 9), "session_id")


def ranked(df: DataFrame, order: Column, tie: str, width: float = 0.001) -> DataFrame:
    """Adds rank, 1 for the smallest ``order`` (ties: ``tie``), without sorting everything in one task: rows are ranked
    within buckets of ``order``, and the buckets' counts, summed in order, are added. The buckets are as many as the values
    span widths; a bucket holds one width's rows."""
    d = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / width))
    n = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_o", tie))
    return d.withColumn("_r", local).join(before, "_b").withColumn("rank", (F.col("_r") + F.col("_before")).cast("int")).drop("_o", "_b", "_r", "_before")


def tick_atr(t: DataFrame, period: int, bar_seconds: int, phase_seconds: float = 0.0) -> DataFrame:
    """(session_id, tick_id, atr_pct) at every priced reading, the unfinished bar included.

    Bars follow the monotonic clock, shifted by ``phase_seconds``; empty ones do not exist. Ready with period + 1
    bars of which the oldest was updated within max((period + 4) * bar_seconds, 300) seconds.
    """
    ns = 1_000_000_000
    p = t.where("price is not null").select("session_id", "tick_id", "sequence", "elapsed_ns", "price")
    p = p.withColumn("bucket", F.floor((F.col("elapsed_ns") + int(phase_seconds * ns)) / (bar_seconds * ns)))
    run = Window.partitionBy("session_id", "bucket").orderBy("elapsed_ns", "sequence", "tick_id")
    p = p.withColumns({"h": F.max("price").over(run), "l": F.min("price").over(run)})
    fin = p.groupBy("session_id", "bucket").agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("elapsed_ns", "sequence", "tick_id")).alias("close"), F.max("elapsed_ns").alias("end_ns")
    )
    o = Window.partitionBy("session_id").orderBy("bucket")
    fin = true_range(fin, ["session_id"], "bucket").withColumns({
        "k": F.row_number().over(o), "earlier": F.coalesce(F.sum("tr").over(o.rowsBetween(1 - period, -1)), F.lit(0.0)), "oldest_end": F.lag("end_ns", period).over(o),
    })
    j = p.join(fin.select("session_id", "bucket", "prev_close", "k", "earlier", "oldest_end"), ["session_id", "bucket"])
    now = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("prev_close")), F.abs(F.col("l") - F.col("prev_close")))
    horizon = max((period + 4) * bar_seconds, 300) * ns
    atr = (F.col("earlier") + now) / period
    ok = (F.col("k") >= period + 1) & (F.col("oldest_end") >= F.col("elapsed_ns") - horizon) & (atr > 0)
    return j.select("session_id", "tick_id", F.when(ok, atr / F.col("price") * 100).alias("atr_pct"))
