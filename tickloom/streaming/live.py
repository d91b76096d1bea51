"""The same operators on live streams: event-time bars, activity sessions, stateful trails, stream joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import settings, ship


def read_ticks(spark: SparkSession, sf_dir: str, schema_of: DataFrame) -> DataFrame:
    """The ticks of a folder as a file stream."""
    return spark.readStream.schema(schema_of.schema).parquet(f"{sf_dir}/ticks.parquet*")


def bars(stream: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """OHLC of the last per symbol and window; windows close ``late`` after their end, later rows are dropped."""
    w = F.window("captured_at_utc", size, slide) if slide else F.window("captured_at_utc", size)
    at = F.struct("captured_at_utc", "tick_id")
    d = stream.where("last > 0").withWatermark("captured_at_utc", late)
    g = d.groupBy(w, "symbol").agg(F.min_by("last", at).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", at).alias("close"), F.count(F.lit(1)).alias("readings"))
    return g.select("symbol", F.unix_micros("window.start").alias("start_us"), "open", "high", "low", "close", "readings")


def activity(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Stretches of readings of a symbol without a pause of ``gap``."""
    g = stream.withWatermark("captured_at_utc", late).groupBy(F.session_window("captured_at_utc", gap), "symbol").agg(F.count(F.lit(1)).alias("readings"))
    return g.select("symbol", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "readings")


def trails(stream: DataFrame, pct: float) -> DataFrame:
    """One row (symbol, t, price, high) each time the last falls ``pct`` percent below its high since the last such event.

    Keyed state holds the high alone; a batch's rows are put in order of (captured_at_utc, tick_id) before they are folded.
    """
    ship(stream.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).drop_duplicates("tick_id").sort_values(["captured_at_utc", "tick_id"])
        high, out = (state.get[0] if state.exists else 0.0), []
        for t, p in zip(rows.captured_at_utc, rows["last"]):
            high = max(high, p)
            if p <= high * (1 - pct / 100):
                out.append((key[0], t, p, high))
                high = p
        state.update((high,))
        yield pd.DataFrame(out, columns=["symbol", "t", "price", "high"])

    d = stream.where("last > 0").select("symbol", "captured_at_utc", "tick_id", "last")
    return d.groupBy("symbol").applyInPandasWithState(fold, "symbol string, t timestamp, price double, high double", "high double", "append", "NoTimeout")


#: A slot of time in the key of a stream join, in multiples of the distance that is allowed.
SLOT = 32
#: What a stream join runs with: its state on disk instead of the heap, one store per partition whose buffers are bounded;
#: and no last batch that only clears state, since an inner join gives a match with the later of its rows.
JOIN = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def matched_feeds(left: DataFrame, right: DataFrame, within: str, late: str) -> DataFrame:
    """Stream-stream inner join on symbol of rows at most ``within`` apart; both have symbol, t and an id (lid, rid).

    A stream join compares a row with every row in state under its key, so a slot of time belongs to the key: a right row
    has one slot, a left row stands in each slot that it can reach, two at most, and a pair meets in one. Start it with JOIN."""
    slot = lambda t: f"unix_micros({t}) div greatest(1, {SLOT} * unix_micros(timestamp_micros(0) + interval {within}))"
    reach = F.expr(f"explode(sequence({slot(f't - interval {within}')}, {slot(f't + interval {within}')}))")
    a = left.withWatermark("t", late).withColumn("slot", reach).alias("a")
    b = right.withWatermark("t", late).withColumn("slot", F.expr(slot("t"))).alias("b")
    near = F.expr(f"a.symbol = b.symbol and a.slot = b.slot and b.t between a.t - interval {within} and a.t + interval {within}")
    return a.join(b, near).select("a.symbol", "lid", "rid")


def run_once(result: DataFrame, target: str, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Processes all there is now into parquet and returns it; the checkpoint lies beside the target. ``conf`` holds for
    this stream alone: it takes the session's settings when it starts."""
    spark = result.sparkSession
    with settings(spark, conf or {}):
        q = result.writeStream.format("parquet").option("checkpointLocation", f"{target}-state").option("path", target).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(target)
