"""Quality of a recorded session against its schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions_once(sessions: DataFrame) -> DataFrame:
    """Each session once, as one of its rows: the one with the latest observed end, then the latest start of the schedule
    and of the observation (a null before anything)."""
    cols = F.struct(
        "con_id", "symbol", "period_id", "session_date", F.unix_micros("schedule_open_utc").alias("open_us"), F.unix_micros("schedule_close_utc").alias("close_us"),
        F.unix_micros("observed_start_utc").alias("start_us"), F.unix_micros("observed_end_utc").alias("end_us"), "close_reason", "status", "frozen_feed",
    )
    order = F.struct(*[F.coalesce(F.unix_micros(c), F.lit(-1)) for c in ("observed_end_utc", "schedule_open_utc", "observed_start_utc", "schedule_close_utc")], F.coalesce("con_id", F.lit(-1)), F.coalesce("session_date", F.lit("")))
    return sessions.where("session_id is not null").groupBy("session_id").agg(F.max_by(cols, order).alias("x")).select("session_id", "x.*")


#: Nanoseconds of the monotonic clock in one slice of a session.
GAP_SLICE = 900_000_000_000


def session_quality(t: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: coverage of the schedule, start lag, end lead, largest gap of the monotonic clock, Last events with a
    last above zero, the share of scheduled minutes, counted from the open, with one of them inside the schedule, and the
    95th percentile of the seconds between them. Shares end at 100, lags and gaps begin at 0. A session without an
    observed end ends with its last reading. ``t`` holds clean readings with prices.

    Windows run per slice of the session's clock; the gap before a slice comes from one row per slice."""
    s = sessions_once(sessions).where("close_us > open_us")
    last = F.col("last_event") & (F.col("last") > 0) & (F.col("last") < float("inf"))
    d = t.select("session_id", "elapsed_ns", "sequence", "tick_id", F.unix_micros("captured_at_utc").alias("us"), F.coalesce(last, F.lit(False)).alias("hit")).withColumn("_slice", F.coalesce(F.floor(F.col("elapsed_ns") / GAP_SLICE), F.lit(-1)))
    w = Window.partitionBy("session_id", "_slice").orderBy("elapsed_ns", "sequence", "tick_id")
    seen = F.when(F.col("hit"), F.col("elapsed_ns"))
    d = d.withColumns({"_p": F.lag("elapsed_ns").over(w), "_lp": F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    gap = lambda a, b: F.when(b.isNotNull(), F.greatest(F.lit(0.0), (a - b) / 1e9))
    inner = F.when(F.col("hit"), gap(F.col("elapsed_ns"), F.col("_lp")))
    per = d.groupBy("session_id", "_slice").agg(
        F.count(F.lit(1)).alias("n"), F.max(gap(F.col("elapsed_ns"), F.col("_p"))).alias("gap"), F.count_if("hit").alias("hits"), F.max("us").alias("us"),
        F.min("elapsed_ns").alias("a"), F.max("elapsed_ns").alias("z"), F.min(seen).alias("la"), F.max(seen).alias("lz"),
    )
    o = Window.partitionBy("session_id").orderBy("_slice")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_g": gap(F.col("a"), F.lag("z").over(o)), "_lg": F.when(F.col("la").isNotNull(), gap(F.col("la"), F.last("lz", True).over(before)))})
    a = per.groupBy("session_id").agg(F.sum("n").alias("readings"), F.max(F.greatest("gap", "_g")).alias("max_gap_s"), F.sum("hits").alias("last_events"), F.max("us").alias("_last_us"))
    gaps = d.select("session_id", inner.alias("g")).unionByName(per.select("session_id", F.col("_lg").alias("g"))).where("g is not null").groupBy("session_id").agg(F.percentile("g", 0.95).alias("p95_last_gap_s"))
    # Minutes of the schedule: distinct ones first, a row each, then their number.
    mins = d.where("hit").join(s.select("session_id", "open_us", "close_us"), "session_id").where("us >= open_us and us < close_us")
    mins = mins.select("session_id", F.expr("(us - open_us) div 60000000").alias("m")).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("minutes"))
    j = s.join(a, "session_id", "left").join(gaps, "session_id", "left").join(mins, "session_id", "left").withColumn("end_us", F.greatest(F.coalesce("end_us", "_last_us"), "start_us"))
    span = (F.col("close_us") - F.col("open_us")) / 1e6
    inside = F.greatest(F.lit(0), F.least("end_us", "close_us") - F.greatest("start_us", "open_us")) / 1e6
    share = lambda x: F.least(F.lit(100.0), x * 100)
    return j.select(
        "session_id", F.coalesce("readings", F.lit(0)).alias("readings"), share(inside / span).alias("coverage_pct"), gap(F.col("start_us") * 1000, F.col("open_us") * 1000).alias("start_lag_s"),
        gap(F.col("close_us") * 1000, F.col("end_us") * 1000).alias("end_lead_s"), "max_gap_s", F.coalesce("last_events", F.lit(0)).alias("last_events"),
        share(F.coalesce("minutes", F.lit(0)) / F.greatest(F.lit(1), F.ceil(span / 60))).alias("minute_coverage_pct"), "p95_last_gap_s",
    )


def continuity_chains(sessions: DataFrame) -> DataFrame:
    """(session_id, con_id, chain): sessions of a contract follow each other in one chain while each date is the weekday
    after the one before and their schedules do not overlap; anything else opens the next chain."""
    from ..functions.scalars import next_weekday, session_day

    s = sessions_once(sessions).withColumn("day", session_day(F.col("session_date")))
    w = Window.partitionBy("con_id").orderBy("open_us", "session_id")
    s = s.withColumns({"_d": F.lag("day").over(w), "_c": F.lag("close_us").over(w)})
    joined = F.coalesce((F.col("day") == next_weekday(F.col("_d"))) & (F.col("open_us") >= F.col("_c")), F.lit(False))
    return s.select("session_id", "con_id", F.sum(F.when(joined, 0).otherwise(1)).over(w).cast("int").alias("chain"))
