"""Streaming operators run over the whole recorded ticks as one available-now stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live
from ..util import shared_dir, table


def _target(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return live.read_ticks(spark, d, table(spark, d, "ticks"))


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closed five-minute bars."""
    return live.run_once(live.bars(_ticks(spark, d), "5 minutes", "10 minutes"), _target(spark))


def stream_sliding_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closed half-hour bars every ten minutes."""
    return live.run_once(live.bars(_ticks(spark, d), "30 minutes", "10 minutes", "10 minutes"), _target(spark))


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Finished stretches without a pause of five minutes."""
    return live.run_once(live.activity(_ticks(spark, d), "5 minutes", "10 minutes"), _target(spark))


def stream_trails(spark: SparkSession, d: str) -> DataFrame:
    """Falls of three percent from the running high, by keyed state."""
    return live.run_once(live.trails(_ticks(spark, d), 3.0), _target(spark))


def stream_near_readings(spark: SparkSession, d: str) -> DataFrame:
    """Different readings of one symbol at most 100 milliseconds apart, as a join of two streams."""
    cols = lambda n: _ticks(spark, d).select("symbol", F.col("captured_at_utc").alias("t"), F.col("tick_id").alias(n))
    return live.run_once(live.matched_feeds(cols("lid"), cols("rid"), "100 milliseconds", "10 minutes").where("lid < rid"), _target(spark), conf=live.JOIN)


QUERIES = {f.__name__: f for f in (stream_bars, stream_sliding_bars, stream_activity, stream_trails, stream_near_readings)}

_BARS = """with t as (select symbol, last, epoch_us(captured_at_utc) as us, tick_id from ticks where last > 0), m as (select max(us) // 1000 * 1000 - 600000000 as mark from t)"""
SQL = {
    "stream_bars": f"""{_BARS}, g as (select symbol, us // 300000000 * 300000000 as start_us, min_by(last, struct_pack(a := us, b := tick_id)) as open, max(last) as high, min(last) as low, max_by(last, struct_pack(a := us, b := tick_id)) as close, count(*) as readings from t group by 1, 2)
select g.* from g, m where start_us + 300000000 <= mark""",
    "stream_sliding_bars": f"""{_BARS}, w as (select *, us // 600000000 * 600000000 - k * 600000000 as start_us from t, range(0, 3) as r(k)),
g as (select symbol, start_us, min_by(last, struct_pack(a := us, b := tick_id)) as open, max(last) as high, min(last) as low, max_by(last, struct_pack(a := us, b := tick_id)) as close, count(*) as readings from w group by 1, 2)
select g.* from g, m where start_us + 1800000000 <= mark""",
    "stream_activity": """with t as (select symbol, epoch_us(captured_at_utc) as us from ticks), m as (select max(us) // 1000 * 1000 - 600000000 as mark from t),
l as (select *, lag(us) over (partition by symbol order by us) as p from t), s as (select *, sum(case when us - p <= 300000000 then 0 else 1 end) over (partition by symbol order by us rows unbounded preceding) as k from l),
g as (select symbol, min(us) as start_us, max(us) + 300000000 as end_us, count(*) as readings from s group by symbol, k) select g.* from g, m where end_us <= mark""",
    "stream_near_readings": """select a.symbol, a.tick_id as lid, b.tick_id as rid from ticks a join ticks b on a.symbol = b.symbol and a.tick_id < b.tick_id and epoch_us(b.captured_at_utc) between epoch_us(a.captured_at_utc) - 100000 and epoch_us(a.captured_at_utc) + 100000""",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "stream_bars": ["open", "high", "low", "close"],
    "stream_sliding_bars": ["open", "high", "low", "close"],
}
