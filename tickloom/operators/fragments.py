"""The best set of recording fragments that do not overlap, per contract and date."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import session_day
from ..util import ship


def schedule(starts: list[int], ends: list[int], ids: list[int]) -> list[int]:
    """Indices of disjoint intervals of the greatest total length; ties prefer fewer intervals, then the smallest ids.

    Weighted interval scheduling over the intervals sorted by end: each step takes the better of leaving the
    interval out and adding it to the best choice that ends before it starts."""
    order = sorted(range(len(starts)), key=lambda i: (ends[i], starts[i], ids[i]))
    close = [ends[i] for i in order]
    best: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]  # length, minus count, chosen
    for n, i in enumerate(order):
        p = bisect.bisect_left(close, starts[i], 0, n)
        length, count, chosen = best[p]
        take = (length + ends[i] - starts[i], count - 1, (*chosen, i))
        skip = best[n]
        names = lambda c: [-ids[j] for j in sorted(c, key=lambda j: ids[j])]
        if take[:2] != skip[:2]:
            best.append(max(take, skip, key=lambda x: x[:2]))
        else:
            best.append(take if names(take[2]) > names(skip[2]) else skip)
    return sorted(best[-1][2])


def _choose(g: pd.DataFrame) -> pd.DataFrame:
    ids = g.fragment_id.tolist()
    keep = schedule(g.start_ms.tolist(), g.end_ms.tolist(), ids)
    return g.iloc[keep][["con_id", "session_day", "fragment_id", "start_ms", "end_ms"]]


def best_fragments(fragments: DataFrame) -> DataFrame:
    """(con_id, session_day, fragment_id, start_ms, end_ms): the chosen fragments.

    Fragments with a null bound or key, or no length, are left out; of equal intervals the smallest id stands. Each
    contract and date is first cut into clusters of overlapping fragments by a window, so a task schedules one cluster
    and not a whole group."""
    from pyspark.sql import Window

    f = fragments.select(
        "con_id", session_day(F.col("session_date")).alias("session_day"), "fragment_id", F.round(F.col("observed_start_timestamp") * 1000).cast("long").alias("start_ms"), F.round(F.col("observed_end_timestamp") * 1000).cast("long").alias("end_ms")
    ).where("con_id is not null and session_day is not null and fragment_id is not null and start_ms < end_ms")
    f = f.groupBy("con_id", "session_day", "start_ms", "end_ms").agg(F.min("fragment_id").alias("fragment_id"))
    ship(fragments.sparkSession)
    # Disjoint clusters are scheduled apart: a cluster ends where no fragment spans the border.
    w = Window.partitionBy("con_id", "session_day").orderBy("start_ms", "end_ms", "fragment_id")
    f = f.withColumn("_reach", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    f = f.withColumn("cluster", F.sum(F.when(F.col("start_ms") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.drop("_reach").groupBy("con_id", "session_day", "cluster").applyInPandas(_choose, "con_id long, session_day date, fragment_id long, start_ms long, end_ms long")
