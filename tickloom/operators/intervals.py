"""Continuous periods and gaps of intervals per entity.

``session_window`` with a row's own duration merges overlapping intervals natively, per entity and slice of the start
time. What is left is post-processed: periods that touch, or that reach over the border of a slice, become one, and a gap
is derived from the next period's start with ``lead``. All of it runs per slice; what a slice must know of the others - how
far earlier periods reach, how many there are, where the next one starts - comes from one summary row per slice, so
an entity of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize

#: Start-time slice of the first merge; any value gives the same result.
SLICE_MS = 3_600_000


def _overlaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge intervals [start_ms, end_ms] that overlap. Spark's sessions are half-open and have a length, so an interval of
    no length is drawn a microsecond long; intervals that touch stay apart."""
    us = F.greatest((F.col("end_ms") - F.col("start_ms")).cast("decimal(20,0)") * 1000, F.lit(1).cast("decimal(20,0)"))
    span = F.make_interval(secs=(us / 1_000_000).cast("decimal(18,6)"))
    d = df.withColumn("_at", F.timestamp_micros(F.col("start_ms") * 1000))
    return d.groupBy(*keys, F.session_window("_at", span)).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("session_window")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[f"_{n}"])
    return on


def _with_slices(df: DataFrame, per: DataFrame, names: list[str]) -> DataFrame:
    """Adds the columns of the summary rows of the same entity and slice."""
    per = per.withColumnsRenamed({n: f"_{n}" for n in names})
    return df.join(per, _same(df, per, names)).drop(*[f"_{n}" for n in names])


def periods_and_gaps(df: DataFrame, keys: list[str], start_ms: Column, end_ms: Column) -> DataFrame:
    """Rows (keys, kind, start_ms, end_ms): the merged periods and the gaps between neighbours of one entity.

    Bounds are epoch milliseconds. Intervals with a null bound or start after end are left out; those of no
    length count; repeated and nested ones merge. Null keys form an entity of their own. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], start_ms.cast("long").alias("start_ms"), end_ms.cast("long").alias("end_ms"))
    slim = slim.where("start_ms <= end_ms")
    key = [*names, "_slice"]
    cut = materialize(_overlaps(slim.withColumn("_slice", F.floor(F.col("start_ms") / SLICE_MS)), key))
    # A period begins where nothing before it, in its slice or an earlier one, reaches its start.
    w, o = Window.partitionBy(*key).orderBy("start_ms", "end_ms"), Window.partitionBy(*names).orderBy("_slice")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.groupBy(*key).agg(F.max("end_ms").alias("_m")).withColumn("_reach", F.max("_m").over(before)).drop("_m")
    cut = _with_slices(cut, reach, key)
    far = F.greatest("_reach", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cut = cut.withColumn("_new", F.when(far.isNull() | (F.col("start_ms") > far), 1).otherwise(0))
    count = cut.groupBy(*key).agg(F.sum("_new").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    cut = _with_slices(cut.withColumn("_local", F.sum("_new").over(w)), count, key)
    merged = cut.groupBy(*names, (F.col("_local") + F.col("_before")).alias("_period")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    merged = materialize(merged.withColumn("_slice", F.floor(F.col("start_ms") / SLICE_MS)))
    later = o.rowsBetween(1, 1)
    nexts = merged.groupBy(*key).agg(F.min("start_ms").alias("_f")).withColumn("_follow", F.first("_f").over(later)).drop("_f")
    merged = _with_slices(merged.withColumn("_lead", F.lead("start_ms").over(Window.partitionBy(*key).orderBy("start_ms"))), nexts, key)
    after = F.coalesce("_lead", "_follow")
    both = merged.withColumn("_next", after).withColumn(
        "_row",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")),
                    F.when(F.col("_next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("end_ms").alias("a"), F.col("_next").alias("b"))),
                )
            )
        ),
    )
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("_row.kind").alias("kind"), F.col("_row.a").alias("start_ms"), F.col("_row.b").alias("end_ms"))


def fragment_periods(fragments: DataFrame) -> DataFrame:
    """Periods and gaps of recorded fragments per con_id and session date (YYYYMMDD, from either spelling)."""
    f = fragments.select(
        "con_id",
        F.regexp_replace(F.trim("session_date"), "-", "").alias("session_date"),
        F.round(F.col("observed_start_timestamp") * 1000).alias("_s"),
        F.round(F.col("observed_end_timestamp") * 1000).alias("_e"),
    ).where("not isnan(_s) and not isnan(_e)")
    return periods_and_gaps(f, ["con_id", "session_date"], F.col("_s"), F.col("_e"))
