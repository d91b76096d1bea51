"""Resampling, survival, scoring, dominance and regime operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_index
from ..util import materialize, small


def kaplan_meier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and distinct event time: at risk, events, survival. ``rows`` has duration and event (true, or censored).

    Counts per distinct time are pre-aggregated; the product runs as a sum of logarithms, zero where all at risk have
    the event."""
    at = rows.where("duration is not null").groupBy(*keys, "duration").agg(F.count_if("event").alias("events"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("duration"))
    up = Window.partitionBy(*keys).orderBy("duration")
    d = at.withColumn("at_risk", F.sum("n").over(down)).where("events > 0")
    d = d.withColumns({"_l": F.sum(F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))).over(up), "_z": F.max(F.col("events") == F.col("at_risk")).over(up)})
    return d.select(*keys, "duration", "at_risk", "events", F.when(F.col("_z"), 0.0).otherwise(F.exp("_l")).alias("survival"))


def horizon_probability(rows: DataFrame, keys: list[str], horizon: float) -> DataFrame:
    """Per group the Kaplan-Meier probability, in percent, of the event within ``horizon``; null where not all had it and
    nothing was observed so long. Durations below zero or not finite are left out."""
    r = rows.where("duration >= 0").where(F.col("duration") < float("inf"))
    # What lasts longer than the horizon counts as at risk alone, so the curve ends there.
    cut = r.withColumns({"event": F.col("event") & (F.col("duration") <= horizon)})
    curve = kaplan_meier(cut, keys).groupBy(*keys).agg(F.min_by("survival", F.col("at_risk")).alias("s"))
    far = r.groupBy(*keys).agg(F.max("duration").alias("longest"))
    j = far.join(curve, keys, "left").withColumn("s", F.coalesce("s", F.lit(1.0)))
    return j.select(*keys, F.when((F.col("s") == 0) | (F.col("longest") >= horizon), (1 - F.col("s")) * 100).alias("probability"))


#: Most buckets of values in which a replicate's median is looked for.
BUCKETS = 64
#: Bytes on disk up to which a table of a row per group or per day is broadcast. Parquet writes such rows, and those of draws
#: and values even more, in a tenth of their memory and less, so their files' size says little: beyond, joins are merged.
FEW_BYTES = 1 << 20


def day_bootstrap(values: DataFrame, keys: list[str], seed: int, replicates: int = 2000) -> DataFrame:
    """Cluster bootstrap by day: ``values`` has keys, day, value. Per group the median, the 80 and 95 % intervals of the
    replicates' medians and the share of positive ones; groups with fewer than 3 days are left out.

    A replicate draws days; a value counts as often as its day was drawn. The medians are exact, without a copy of the
    values per replicate: values fall into buckets, a replicate adds up the days' counts per bucket, and only the bucket
    that holds its middle ranks is looked into. That makes replicates x (days x buckets + values / buckets) rows, least for
    the root of values / days, which is the number of buckets, BUCKETS at most. Draws and values are merged, never
    broadcast."""
    v = values.where("value is not null").groupBy(*keys, "day", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    days = v.groupBy(*keys, "day").agg(F.sum("c").alias("n"))
    days = materialize(days.withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "k": F.count(F.lit(1)).over(w), "few": F.greatest(F.lit(2.0), F.least(F.lit(float(BUCKETS)), F.round(F.sqrt(F.avg("n").over(w)))))}).where("k >= 3"))
    cuts = materialize(v.groupBy(*keys).agg(F.percentile_approx("value", F.array(*[F.lit(q / BUCKETS) for q in range(1, BUCKETS)]), 1000).alias("_cuts")))
    v = v.hint("merge").join(small(cuts, FEW_BYTES), keys).hint("merge").join(small(days, FEW_BYTES).select(*keys, "day", "i", "few"), [*keys, "day"])
    v = materialize(v.withColumn("b", F.floor(F.size(F.filter("_cuts", lambda x: F.col("value") > x)) * F.col("few") / BUCKETS)).drop("_cuts", "few"))
    # The days are few rows in few tasks; their draws are spread before they are hashed.
    wide = days.select(*keys, "i", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).repartition("rep")
    draws = wide.select(*keys, "rep", hash_index(F.lit(seed), F.col("rep"), F.col("i"), F.col("k")).alias("i"))
    times = materialize(draws.groupBy(*keys, "rep", "i").agg(F.count(F.lit(1)).alias("times")))
    # Which bucket holds a replicate's two middle ranks.
    per = times.hint("merge").join(v.groupBy(*keys, "i", "b").agg(F.sum("c").alias("n")), [*keys, "i"]).groupBy(*keys, "rep", "b").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    r = Window.partitionBy(*keys, "rep")
    per = per.withColumns({"upto": F.sum("n").over(r.orderBy("b")), "all": F.sum("n").over(r)})
    per = per.withColumn("rank", F.explode(F.array(F.expr("(all - 1) div 2"), F.expr("all div 2")))).where("rank >= upto - n and rank < upto")
    need = per.groupBy(*keys, "rep", "b").agg(F.min(F.col("rank") - F.col("upto") + F.col("n")).alias("lo"), F.max(F.col("rank") - F.col("upto") + F.col("n")).alias("hi"))
    # The values of that bucket in order, each as often as its day was drawn.
    inside = need.hint("merge").join(v, [*keys, "b"]).hint("merge").join(times, [*keys, "rep", "i"]).groupBy(*keys, "rep", "b", "value").agg(F.sum(F.col("c") * F.col("times")).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "rep", "b").orderBy("value"))
    inside = inside.withColumn("upto", upto)
    hit = lambda x: F.max(F.when((F.col(x) >= F.col("upto") - F.col("n")) & (F.col(x) < F.col("upto")), F.col("value")))
    two = inside.groupBy(*keys, "rep", "b").agg(hit("lo").alias("x"), hit("hi").alias("y"))
    # Both ranks in one bucket, or the last of one and the first of the next.
    rep = two.groupBy(*keys, "rep").agg(((F.min("x") + F.max("y")) / 2).alias("m"))
    ci = rep.groupBy(*keys).agg(F.percentile("m", F.array(*map(F.lit, (0.025, 0.1, 0.9, 0.975)))).alias("q"), F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("positive"))
    base = v.groupBy(*keys).agg(F.percentile("value", 0.5, F.col("c")).alias("median")).hint("merge").join(days.groupBy(*keys).agg(F.max("k").alias("days")), keys)
    return base.hint("merge").join(ci, keys).select(*keys, "days", "median", F.col("q")[0].alias("lo95"), F.col("q")[1].alias("lo80"), F.col("q")[2].alias("hi80"), F.col("q")[3].alias("hi95"), "positive")


def leave_one_day_out(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of at least 3 days: the smallest, middle and largest median when one day is left out, how often its sign
    turns against that of all values, and the day whose omission moves it most (ties: the earliest).

    Without a day of m values the middle values of the rest lie at most m ranks above their place among the rest, so
    each day looks at m + 2 ranks: about as many rows in all as there are values."""
    w = Window.partitionBy(*keys)
    v = values.where("value is not null").select(*keys, "day", "value").withColumn("r", F.row_number().over(w.orderBy("value", "day")) - 1)
    days = v.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("m")).withColumns({"n": F.sum("m").over(w), "k": F.count(F.lit(1)).over(w)}).where("k >= 3")
    days = days.withColumns({"t0": F.expr("(n - m - 1) div 2"), "t1": F.expr("(n - m) div 2")}).withColumnRenamed("day", "out")
    look = days.withColumn("r", F.explode(F.sequence("t0", F.col("t1") + F.col("m")))).select(*keys, "out", "t0", "t1", "r")
    look = look.hint("merge")  # as many rows as values, which the optimizer takes for as many as days: never to the driver
    c = look.join(v, [*keys, "r"]).withColumn("own", F.col("day") == F.col("out"))
    below = v.hint("merge").join(days.select(*keys, F.col("out").alias("day"), "t0"), [*keys, "day"]).groupBy(*keys, "day").agg(F.count_if(F.col("r") < F.col("t0")).alias("under")).withColumnRenamed("day", "out")
    # A value's rank among the rest is its rank less the day's own values before it.
    own = F.sum(F.when(F.col("own"), 1).otherwise(0)).over(Window.partitionBy(*keys, "out").orderBy("r"))
    c = c.withColumn("_own", own).hint("merge").join(below, [*keys, "out"]).withColumn("rest", F.col("r") - F.col("_own") - F.col("under")).where("not own and rest between t0 and t1")
    est = c.groupBy(*keys, "out").agg(F.avg("value").alias("e"))
    full = v.groupBy(*keys).agg(F.percentile("value", 0.5).alias("median"))
    j = est.hint("merge").join(full, keys).withColumn("move", F.round(F.abs(F.col("e") - F.col("median")), 9))
    turned = F.count_if((F.abs("median") > 1e-12) & (F.col("e") != 0) & (F.signum("e") != F.signum("median")))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.min("e").alias("lowest"), F.percentile("e", 0.5).alias("middle"), F.max("e").alias("highest"), turned.alias("sign_reversals"), F.max_by("out", F.struct("move", -F.datediff("out", F.lit("1970-01-01")))).alias("influential_day")
    )


def moving_block_length(units: int) -> int | None:
    """See ``functions.scalars.block_length``; on the driver."""
    return None if units < 15 else 2 if units < 30 else 3 if units < 60 else min(5, max(3, round(units ** (1 / 3))))


#: Fixed value: what the stream of block draws is seeded with, besides the seed and the sizes.
BLOCK_TAG = "market-replay-moving-block-v1"


def block_indices(spark: SparkSession, seed: str, replicates: int, units: int, length: int) -> DataFrame:
    """(rep, pos, unit): circular moving-block draws, eight bytes of one SHAKE-256 stream per block. The starts are made on
    the driver: eight bytes for each of replicates x units / length blocks."""
    blocks = -(-units // length)
    stream = hashlib.shake_256(f"{BLOCK_TAG}|{seed}|{replicates}|{units}|{length}".encode()).digest(8 * replicates * blocks)
    rows = [(i // blocks, i % blocks, int.from_bytes(stream[8 * i : 8 * i + 8], "big") % units) for i in range(replicates * blocks)]
    b = spark.createDataFrame(rows, "rep int, block int, start int")
    return b.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select("rep", (F.col("block") * length + F.col("o")).alias("pos"), F.pmod(F.col("start") + F.col("o"), F.lit(units)).alias("unit")).where(f"pos < {units}")


def walk_forward(units: int, train: int, validate: int) -> list[tuple[range, range]]:
    """Expanding folds: train on everything before, validate on the next block; the last, shorter block is left out."""
    return [(range(0, a), range(a, a + validate)) for a in range(train, units - validate + 1, validate)]


def score(rows: DataFrame, keys: list[str], policies: DataFrame) -> DataFrame:
    """Per group and policy: weighted median, mean and worst of value, less drawdown and open-share penalties.

    ``rows`` has value, drawdown, open; ``policies`` is a handful of literal rows (policy and six weights)."""
    a = rows.groupBy(*keys).agg(
        F.median("value").alias("median"), F.avg("value").alias("mean"), F.min("value").alias("worst"), F.max("drawdown").alias("drawdown"), F.avg(F.when(F.col("open"), 1.0).otherwise(0.0)).alias("open_share"), F.count(F.lit(1)).alias("n")
    )
    j = a.join(F.broadcast(policies))
    s = F.col("w_median") * F.col("median") + F.col("w_mean") * F.col("mean") + F.col("w_worst") * F.col("worst") - F.col("w_drawdown") * F.col("drawdown") - F.col("w_open") * F.col("open_share")
    return j.select(*keys, "policy", "n", s.alias("score"))


def pareto_front(points: DataFrame, key: str, up: list[str], down: list[str]) -> DataFrame:
    """The points no other point dominates: at least as good everywhere, better somewhere, each by a tolerance of 1e-9; equal
    points keep each other.

    For a candidate summary, one row per candidate. A theta join has no equi key, so the 200 points of the greatest sum,
    a fixed number, are broadcast first and remove nearly every dominated point; the exact check runs among the rest."""
    dims = [*up, *down]
    good = [(F.col(c) if c in up else -F.col(c)).alias(f"g{i}") for i, c in enumerate(dims)]
    p = points.dropna(subset=dims).select(F.col(key).alias("k"), *good)
    q = p.select(F.col("k").alias("ok"), *[F.col(f"g{i}").alias(f"o{i}") for i in range(len(dims))])
    n = range(len(dims))
    every = " and ".join(f"o{i} >= g{i} - 1e-9" for i in n)
    some = " or ".join(f"o{i} > g{i} + 1e-9" for i in n)
    champs = F.broadcast(q.orderBy(F.desc(sum((F.col(f"o{i}") for i in n), F.lit(0.0)))).limit(200))
    rest = p.join(champs, F.expr(f"({every}) and ({some})"), "left_anti")
    others = rest.select(F.col("k").alias("ok"), *[F.col(f"g{i}").alias(f"o{i}") for i in n])
    keep = rest.join(others, F.expr(f"({every}) and ({some})"), "left_anti").select(F.col("k").alias(key))
    return points.join(keep, key, "left_semi")


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Contiguous regimes of one value (A, B, A are three): number, value, rows, first and last order value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("regime", F.sum("_new").over(w).cast("int"))
    return d.groupBy(*keys, "regime").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def drawdown(rows: DataFrame, keys: list[str], order: list[str], equity: str) -> DataFrame:
    """Per group the largest fall from the running peak in basis points, and the total return."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_peak", F.max(equity).over(w))
    return d.groupBy(*keys).agg(
        F.max((F.col("_peak") - F.col(equity)) / F.col("_peak") * 10000).alias("max_drawdown_bps"),
        ((F.max_by(equity, F.struct(*order)) / F.min_by(equity, F.struct(*order)) - 1) * 10000).alias("return_bps"),
    )
