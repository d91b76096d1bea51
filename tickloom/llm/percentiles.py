"""Exact and mergeable percentiles of very large numeric columns by radix selection.

Doubles map to 64-bit integers in the same order. Each pass histograms the next digit, per group and prefix,
and only the digit that holds a target rank is followed; after four digits of 16 bits the value is exact. A
histogram of the leading digits alone is a summary of bounded relative error that adds up over days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, ship, small

#: Bits of one digit; four digits make up a double.
DIGIT = 16


def _to_bits(v: pa.Array) -> pa.Array:
    x = v.to_numpy(zero_copy_only=False).astype("float64") + 0.0  # -0.0 as 0.0; null as NaN
    raw = x.view("int64")
    return pa.array(np.where(raw >= 0, raw, -(raw & np.int64((1 << 63) - 1))), mask=np.isnan(x))


def _from_bits(k: pa.Array) -> pa.Array:
    gone = np.asarray(k.is_null())
    bits = k.fill_null(0).to_numpy()
    v = np.abs(bits).view("float64")
    return pa.array(np.where(bits < 0, -v, v), mask=gone)


def ordered_bits(c: Column) -> Column:
    """The double as a signed long in the order of the values (-0.0 as 0.0); null for null and NaN. Arrow batches."""
    return F.arrow_udf(_to_bits, "long")(c)


def from_bits(k: Column) -> Column:
    """The inverse of ordered_bits."""
    return F.arrow_udf(_from_bits, "double")(k)


def digit_histogram(df: DataFrame, keys: list[str], bits: str, width: int) -> DataFrame:
    """(keys, prefix, n): counts of the leading ``width`` bits. Histograms of parts add up to that of the whole."""
    return df.groupBy(*keys, F.shiftright(F.col(bits), 64 - width).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds histograms of separate days or partitions."""
    return parts.groupBy(*keys, "prefix").agg(F.sum("n").alias("n"))


def _follow(hist: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """For each target (keys, parent, rank) the digit that holds it, with the rank left inside. hist: (keys, parent, prefix, n)."""
    w = Window.partitionBy(*keys, "parent").orderBy("prefix")
    h = hist.withColumn("upto", F.sum("n").over(w)).withColumn("below", F.col("upto") - F.col("n"))
    j = targets.join(h, [*keys, "parent"]).where("rank >= below and rank < upto")
    return j.select(*keys, "q", "ord", "share", "prefix", (F.col("rank") - F.col("below")).alias("rank"))


def _targets(hist: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """The two neighbouring ranks of each percentile, and the share of the upper one (linear interpolation)."""
    n = hist.groupBy(*keys).agg(F.sum("n").alias("n"))
    t = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    pos = F.col("q") * (F.col("n") - 1)
    low = F.floor(pos)
    t = t.withColumn("share", pos - low).withColumn("_r", F.explode(F.array(F.struct(F.lit(0).alias("ord"), low.alias("rank")), F.struct(F.lit(1).alias("ord"), F.least(low + 1, F.col("n") - 1).alias("rank")))))
    return t.select(*keys, "q", "share", "_r.ord", "_r.rank")


def _join_ranks(found: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The interpolated value of each percentile from its two ranks."""
    v = found.select(*keys, "q", "ord", "share", value.alias("v"))
    two = v.groupBy(*keys, "q").agg(F.max("share").alias("share"), F.max(F.when(F.col("ord") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("ord") == 1, F.col("v"))).alias("b"))
    return two.select(*keys, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys, q, value): exact percentiles with linear interpolation between neighbouring ranks.

    Nulls and NaN are left out; groups without values have no row; null keys form a group; infinities order as
    usual. Each pass groups by (keys, digit) with map-side partial counts, so a hot group is no single task.
    """
    ship(df.sparkSession)
    names = [f"_g{i}" for i in range(len(keys))]
    # A key and whether it is null: two columns, so no value of a key stands for null.
    flags = [f"_n{i}" for i in range(len(keys))]
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names)]
    slim = df.select(*text, *[F.col(k).isNull().alias(f) for k, f in zip(keys, flags)], ordered_bits(F.col(value).cast("double")).alias("bits")).where("bits is not null")
    names += flags
    slim = materialize(slim)
    hist = materialize(digit_histogram(slim, names, "bits", DIGIT).withColumn("parent", F.lit(0).cast("long")))
    targets = _targets(hist, names, qs).withColumn("parent", F.lit(0).cast("long"))
    found = materialize(_follow(hist, names, targets))
    for width in range(2 * DIGIT, 65, DIGIT):
        # Only values under a followed digit are counted again; the followed digits are few, and counted before they are sent along.
        live = small(found.select(*names, F.col("prefix").alias("parent")).distinct())
        inside = slim.withColumn("parent", F.shiftright("bits", 64 - width + DIGIT)).join(live, [*names, "parent"], "left_semi")
        hist = digit_histogram(inside, [*names, "parent"], "bits", width)
        found = materialize(_follow(hist, names, found.withColumnRenamed("prefix", "parent")))
    out = _join_ranks(found, names, from_bits(F.col("prefix")))
    return out.select(*[F.when(~F.col(f), F.col(n)).alias(k) for k, n, f in zip(keys, names, flags)], "q", "value")


def sketch_percentiles(hist: DataFrame, keys: list[str], qs: list[float], width: int) -> DataFrame:
    """(keys, q, value) from a leading-bits histogram alone. A returned rank value is off by at most one part in 2^(width - 12)."""
    found = _follow(hist.withColumn("parent", F.lit(0).cast("long")), keys, _targets(hist, keys, qs).withColumn("parent", F.lit(0).cast("long")))
    # The middle of the bucket: half a bucket above its lower end.
    return _join_ranks(found, keys, from_bits(F.shiftleft("prefix", 64 - width) + (1 << (63 - width))))
