"""Replays of a grid of trailing settings over all recorded chains, and what is derived from them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, evidence, quality, quotes, replay, stats
from ..util import materialize, settings, table

CONTROL = "control"
#: Initial, rebound, profit and trail as multiples of the ATR%; and protective stops around the control.
GRID = {CONTROL: replay.Setting(1.5, 0.75, 1.0, 1.0)}
GRID |= {f"{a:.2f}/{b:.2f}/{c:.2f}/{e:.2f}": replay.Setting(a, b, c, e) for a, b, c, e in itertools.product((0.75, 2.25), (0.0, 1.25), (0.5, 1.5), (0.0, 1.25))}
GRID |= {f"protect/{kind}/{v:.1f}": replay.Setting(1.5, 0.75, 1.0, 1.0, protect=kind, protect_value=v) for kind, v in (("manual", 1.0), ("manual", 3.0), ("atr", 2.0), ("atr", 4.0))}
REPLICATES = 2000
#: Readings are clustered by session: joins by the session and more keys need no shuffle of their own.
CLUSTERED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def readings(spark: SparkSession, d: str) -> DataFrame:
    """What is replayed, written once: every batch of settings reads it."""
    t = quotes.with_prices(quotes.clean_ticks(table(spark, d, "ticks"), clustered=True))
    atr = bars.tick_atr(t, 14, 60)
    s = quality.sessions_once(table(spark, d, "sessions")).select("session_id", "open_us", "close_us").where("open_us < close_us")
    chains = quality.continuity_chains(table(spark, d, "sessions")).join(s, "session_id")
    t = t.withColumn("us", F.unix_micros("captured_at_utc")).drop("con_id")
    r = t.join(atr, ["session_id", "tick_id"], "left").join(chains, "session_id").where("con_id is not null and us is not null and elapsed_ns is not null")
    with settings(spark, CLUSTERED):
        return materialize(r.select(*replay.READING))


def replay_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every setting's result in every session."""
    return replay.replay(readings(spark, d), GRID)[0]


def replay_trades(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(readings(spark, d), GRID)[1]


def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return replay.summarize(replay_sessions(spark, d))


def replay_chains(spark: SparkSession, d: str) -> DataFrame:
    return replay.chain_economics(replay_sessions(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each setting's return less the control's, session by session."""
    s = materialize(replay_sessions(spark, d).select("profile", "session_id", "con_id", "conservative_bps"))  # the control's side and the others' read it
    p = evidence.pairs_with_control(s, "profile", F.col("profile") == CONTROL, ["session_id"], "conservative_bps", ["con_id"])
    days = quality.sessions_once(table(spark, d, "sessions")).select("session_id", F.to_date(F.timestamp_micros("open_us")).alias("day"))
    return p.join(days, "session_id").withColumnRenamed("delta", "value")


def replay_paired(spark: SparkSession, d: str) -> DataFrame:
    """Every setting against the control by days: median difference with its intervals, and what leaving a day out does to it."""
    p = materialize(_pairs(spark, d))
    return stats.day_bootstrap(p, ["profile"], 7, REPLICATES).join(stats.leave_one_day_out(p, ["profile"]).select("profile", "lowest", "highest", "sign_reversals", "influential_day"), "profile")


def replay_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Moving-block bootstrap of each setting's mean difference to the control over the days: interval and share above zero."""
    p = materialize(_pairs(spark, d).groupBy("profile", "day").agg(F.avg("value").alias("m")))
    days = sorted(r.day for r in p.select("day").distinct().collect())  # one row per trading day
    units = spark.createDataFrame(list(enumerate(days)), "unit int, day date")
    ix = stats.block_indices(spark, "7", REPLICATES, max(len(days), 1), stats.moving_block_length(len(days)) or 1)
    rep = ix.join(F.broadcast(units), "unit").join(p, "day").groupBy("profile", "rep").agg(F.avg("m").alias("m"))
    return rep.groupBy("profile").agg(F.count(F.lit(1)).alias("replicates"), F.percentile("m", F.lit(0.1)).alias("lo80"), F.percentile("m", F.lit(0.9)).alias("hi80"), F.avg(F.when(F.col("m") > 0, 100.0).otherwise(0.0)).alias("positive_pct"))


QUERIES = {f.__name__: f for f in (replay_sessions, replay_trades, replay_summary, replay_chains, replay_paired, replay_blocks)}
SQL: dict[str, str] = {}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "replay_sessions": ["realized", "marked", "conservative_bps", "drawdown_bps"],
}
