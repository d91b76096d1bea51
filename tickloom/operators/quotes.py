"""Level-1 readings: sound quotes, event flags, feed evidence, order checks, redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import finite

#: Columns that make up a reading; the time it landed differs between deliveries.
READING = ["session_id", "tick_id", "sequence", "captured_at_utc", "elapsed_ns", "symbol", "con_id", "bid", "ask", "last", "close", "mark_price", "bid_size", "ask_size", "market_data_type", "changed_fields"]


def clean_ticks(ticks: DataFrame, columns: list[str] | None = None, clustered: bool = False) -> DataFrame:
    """Each reading once. Rows are spread by (session, tick), so a hot session is many tasks; ``clustered`` brings each
    session into one task instead, for the operators whose windows need a whole session in order: one shuffle in all."""
    d = ticks.where("tick_id is not null").select(*(columns or READING))
    return (d.repartition("session_id") if clustered else d).dropDuplicates(["session_id", "tick_id"])


def with_prices(t: DataFrame) -> DataFrame:
    """Adds vbid, vask (sound and not crossed), price (the last inside the touch, else its middle; without a touch the
    first positive of mark, last, close) and the event flags; a blank change list is a full snapshot."""
    pos = lambda c: F.when(finite(F.col(c)) > 0, F.col(c))
    t = t.withColumns({"_b": pos("bid"), "_a": pos("ask"), "_l": pos("last")})
    crossed = F.coalesce(F.col("_a") < F.col("_b"), F.lit(False))
    t = t.withColumns({"vbid": F.when(~crossed, F.col("_b")), "vask": F.when(~crossed, F.col("_a"))})
    touch = F.when(F.col("_l").between(F.col("vbid"), F.col("vask")), F.col("_l")).otherwise((F.col("vbid") + F.col("vask")) / 2)
    price = F.when(F.col("vbid").isNotNull() & F.col("vask").isNotNull(), touch).otherwise(F.coalesce(pos("mark_price"), F.col("_l"), pos("close")))
    names = F.concat(F.lit(","), F.regexp_replace(F.coalesce("changed_fields", F.lit("")), " ", ""), F.lit(","))
    full = names == ",,"
    flag = lambda n: (full | names.contains(f",{n},")).alias(n)
    t = t.withColumns({"price": price, "full_snapshot": full, "last_event": flag("last"), "bid_event": flag("bid"), "ask_event": flag("ask")})
    return t.drop("_b", "_a", "_l")


def live_rows(t: DataFrame) -> DataFrame:
    """Per session its live readings, or the delayed ones if it has no live one (types 1 and 3)."""
    any_live = F.max(F.when(F.col("market_data_type") == 1, 1).otherwise(0)).over(Window.partitionBy("session_id"))
    return t.withColumn("_live", any_live).where("market_data_type = case when _live = 1 then 1 else 3 end").drop("_live")


def feed_evidence(t: DataFrame) -> DataFrame:
    """Per session the readings by feed type, and whether the feed was live, mixed or frozen at any time."""
    n = lambda k: F.count_if(F.col("market_data_type") == k)
    d = t.groupBy("session_id").agg(n(1).alias("live"), n(2).alias("frozen"), n(3).alias("delayed"), n(4).alias("delayed_frozen"))
    kinds = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("live", "frozen", "delayed", "delayed_frozen")), F.lit(0))
    return d.withColumns({"any_live": F.col("live") > 0, "mixed": kinds > 1, "any_frozen": (F.col("frozen") + F.col("delayed_frozen")) > 0})


#: Sequence numbers of one slice of a session's order checks.
CHECK_SLICE = 4096


def order_checks(t: DataFrame) -> DataFrame:
    """Per session, in sequence order: holes in the sequence, reversals of the wall clock and of the monotonic clock.

    ``t`` may hold repeated deliveries. Neighbours are compared within slices of the sequence, so a session of any size is
    many tasks; the first and the last reading of each slice, one row, are then compared over the borders."""
    cols = ["sequence", "captured_at_utc", "elapsed_ns"]
    t = t.where("tick_id is not null").select("session_id", "tick_id", *cols).withColumn("_slice", F.coalesce(F.floor(F.col("sequence") / CHECK_SLICE), F.lit(-1)))
    w = Window.partitionBy("session_id", "_slice").orderBy("sequence", "tick_id")
    d = t.withColumn("_id", F.lag("tick_id").over(w)).where("_id is null or _id <> tick_id")  # a second delivery stands beside the first
    d = d.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    bad = {
        "sequence_breaks": lambda c, q: c["sequence"] != q["sequence"] + 1,
        "wall_reversals": lambda c, q: c["captured_at_utc"] < q["captured_at_utc"],
        "clock_reversals": lambda c, q: c["elapsed_ns"] < q["elapsed_ns"],
    }
    here = {c: F.col(c) for c in cols}
    at, row = F.struct("sequence", "tick_id"), F.struct(*cols)
    s = d.groupBy("session_id", "_slice").agg(F.count(F.lit(1)).alias("readings"), *[F.count_if(f(here, F.col("_p"))).alias(n) for n, f in bad.items()], F.min_by(row, at).alias("_a"), F.max_by(row, at).alias("_z"))
    s = s.withColumn("_q", F.lag("_z").over(Window.partitionBy("session_id").orderBy("_slice")))
    border = {n: F.coalesce(F.when(f(F.col("_a"), F.col("_q")), 1), F.lit(0)) for n, f in bad.items()}
    return s.groupBy("session_id").agg(F.sum("readings").alias("readings"), *[F.sum(F.col(n) + border[n]).alias(n) for n in bad])


#: Nanoseconds of the monotonic clock in one slice of a session's compression.
COMPRESS_SLICE = 900_000_000_000


def compress(t: DataFrame) -> DataFrame:
    """Readings that tell something new: the first and last, full snapshots, Last events, a change of the feed or of the
    signature (sound quote and price), and the first priced reading of a second.

    A dropped reading equals the last kept one in its signature, so the reading before decides and no fold is needed.
    Windows run per slice of the session's clock; what lies before a slice comes from one row per slice.
    """
    order = [F.col("elapsed_ns"), F.col("sequence"), F.col("tick_id")]
    key = ["session_id", "_slice"]
    w = Window.partitionBy(*key).orderBy(*order)
    sig = F.struct("vbid", "vask", "price", "market_data_type")
    second = F.when(F.col("price").isNotNull(), F.floor(F.unix_micros("captured_at_utc") / 1_000_000))
    d = t.withColumns({"_sig": sig, "_sec": second, "_slice": F.coalesce(F.floor(F.col("elapsed_ns") / COMPRESS_SLICE), F.lit(-1))})
    at = F.struct(*order)
    s = d.groupBy(*key).agg(F.max_by("_sig", at).alias("_s"), F.max_by("_sec", F.when(F.col("_sec").isNotNull(), at)).alias("_c"))
    o = Window.partitionBy("session_id").orderBy("_slice")
    s = s.select(
        F.col("session_id").alias("_k"), F.col("_slice").alias("_l"), F.lag("_s").over(o).alias("_bs"), F.last("_c", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_bc"),
        (F.row_number().over(o) == 1).alias("_head"), F.lead("_slice").over(o).isNull().alias("_tail"),
    )
    d = d.withColumns({
        "_n": F.row_number().over(w), "_more": F.lead(F.lit(1)).over(w), "_p": F.lag("_sig").over(w),
        "_ps": F.last("_sec", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    d = d.join(s, d["session_id"].eqNullSafe(s["_k"]) & (d["_slice"] == s["_l"]))
    before = F.when(F.col("_n") > 1, F.col("_p")).otherwise(F.col("_bs"))
    ends = ((F.col("_n") == 1) & F.col("_head")) | (F.col("_more").isNull() & F.col("_tail"))
    keep: Column = ends | F.col("full_snapshot") | F.col("last_event") | ~F.col("_sig").eqNullSafe(before) | (F.col("_sec").isNotNull() & ~F.col("_sec").eqNullSafe(F.coalesce("_ps", "_bc")))
    return d.where(keep).select(*t.columns)
