"""Irregular readings onto a regular grid, with missing periods imputed and marked.

Readings are bucketed in the JVM (map-side combined). The bars of a session are cut into blocks of bounded
length, each with OVERLAP bars of its neighbours; per block an iterative singular-spectrum imputation embeds the
series in a Hankel matrix, keeps its leading singular vectors, replaces the missing entries by the reconstruction
and repeats until they settle. A series that does not settle is given up once PATIENCE rounds brought its steps down
by less than a tenth; its bars are marked. A block with too few readings is interpolated between those around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, ship, small

#: Bars of one imputation block; bounds the memory of a task, whatever a session's length.
BLOCK = 4096
#: Bars of either neighbour that an imputation block sees.
OVERLAP = 512
#: Rounds in which the imputation's steps must fall by a tenth.
PATIENCE = 1000


def ssa_impute(y: np.ndarray, window: int = 24, rank: int = 3, tol: float = 1e-4) -> np.ndarray:
    """``y`` with its NaNs replaced, see ``ssa_settle``."""
    return ssa_settle(y, window, rank, tol)[0]


def ssa_settle(y: np.ndarray, window: int = 24, rank: int = 3, tol: float = 1e-4, around: tuple[tuple[int, float], ...] = ()) -> tuple[np.ndarray, bool]:
    """(``y`` with its NaNs replaced, whether the last step was below tol); of a series that does not settle, the values with the smallest step.

    around has readings (position, value) before and after ``y``, from which its ends are interpolated. Without readings all stay
    NaN; with fewer than 3 readings or 8 bars that interpolation, which carries the nearest reading at an open end, stands."""
    n, miss = len(y), np.isnan(y)
    far = sorted(p for p in around if not 0 <= p[0] < n)
    if not miss.any() or (miss.all() and not far):
        return y.copy(), True
    at = np.flatnonzero(~miss)
    known = sorted([*far, *zip(at.tolist(), y[at].tolist())])
    x = np.interp(np.arange(n), [p for p, _ in known], [v for _, v in known])
    if len(at) < 3 or n < 8:
        return x, True
    mean, scale = y[at].mean(), y[at].std()
    if scale <= 1e-12 * max(1.0, abs(mean)):
        return x, True
    x = (x - mean) / scale
    width = max(2, min(window, n // 2))
    count = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(width, n - width + 1))
    diagonal = (np.arange(width)[:, None] + np.arange(n - width + 1)).ravel()
    least, held, kept, waited = np.inf, np.inf, x[miss], 0
    while waited < PATIENCE:
        h = np.lib.stride_tricks.sliding_window_view(x, n - width + 1)
        _, vec = np.linalg.eigh(h @ h.T)
        u = vec[:, -rank:]
        p = u @ (u.T @ h)
        new = (np.bincount(diagonal, p.ravel(), minlength=n) / count)[miss]
        moved = np.abs(new - x[miss]).max()
        x[miss] = new
        if moved < least:
            least, kept = moved, new
        if moved < tol:
            break
        waited += 1
        if least < 0.9 * held:
            held, waited = least, 0
    x[miss] = kept
    out = x * scale + mean
    out[~miss] = y[~miss]
    return out, least < tol


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        cols = {n: b.column(n) for n in ("_first", "_n", "_bar", "_bars", "_block")}
        idx, val, around = b.column("_idx"), b.column("_val"), [b.column("_prev"), b.column("_next")]
        for r in range(b.num_rows):
            first, n, bar, bars, block = (c[r].as_py() for c in cols.values())
            at = block * BLOCK
            lo, hi = max(0, at - OVERLAP), min(bars, at + BLOCK + OVERLAP)
            y = np.full(hi - lo, np.nan)
            if idx[r].is_valid:
                y[np.asarray(idx[r].values) - lo] = np.asarray(val[r].values)
            x, settled = ssa_settle(y, around=tuple((p["_i"] - lo, p["last"]) for p in (c[r].as_py() for c in around) if p is not None))
            own = slice(at - lo, at - lo + n)
            gone = np.isnan(y[own])
            parts.append((np.full(n, r), first + (at + np.arange(n, dtype="int64")) * bar, x[own], gone, ~gone | settled))
        if not parts:
            continue
        row, start, x, gone, settled = (np.concatenate(p) for p in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [b.column("_s").take(pa.array(row)), pa.array(start), pa.array(x, from_pandas=True), pa.array(gone), pa.array(settled)], names=["session_id", "bar_start", "value", "filled", "settled"]
        )


def regular_bars(ticks: DataFrame, sessions: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row (session_id, bar_start, value, filled, settled) per bar of every scheduled session.

    Bars start at multiples of the instrument's atr_bar_seconds, from the one holding schedule_open_utc to the
    last that starts before schedule_close_utc. value is the bar's latest non-null, finite last (ties: the
    largest tick_id); bars without one have filled = true and an imputed value, null where the session has
    no reading at all; settled is false where the imputation did not come to rest. Repeated sessions count once; sessions with a null id, bound or instrument, a bar length
    below 1 or a close not after the open have no bars. Ticks outside the schedule, without a session, or
    repeated change nothing.
    """
    ship(ticks.sparkSession)
    bars = instruments.groupBy("con_id").agg(F.max("atr_bar_seconds").cast("long").alias("_bar"))
    s = sessions.where("session_id is not null").groupBy("session_id").agg(F.min(F.struct("con_id", "schedule_open_utc", "schedule_close_utc")).alias("x"))
    s = s.select(F.col("session_id").alias("_s"), "x.*").join(bars, "con_id").where("_bar >= 1")
    us = F.col("_bar") * 1_000_000
    s = s.withColumn("_first", F.expr("unix_micros(schedule_open_utc) div (_bar * 1000000)") * F.col("_bar"))
    s = s.withColumn("_bars", ((F.unix_micros("schedule_close_utc") - 1 - F.col("_first") * 1_000_000) / us).cast("long") + 1)
    s = materialize(s.where("schedule_close_utc > schedule_open_utc and _bars > 0").select("_s", "_bar", "_first", "_bars"))
    t = ticks.where(F.col("last").isNotNull() & ~F.isnan("last") & (F.abs("last") != float("inf"))).select(
        F.col("session_id").alias("_s"), F.unix_micros("captured_at_utc").alias("_us"), "tick_id", F.col("last").cast("double").alias("last")
    )
    t = t.join(small(s), "_s").withColumn("_i", F.floor((F.col("_us") - F.col("_first") * 1_000_000) / us))
    t = t.where("_i >= 0 and _i < _bars").groupBy("_s", "_i").agg(F.max_by("last", F.struct("_us", "tick_id")).alias("last"), F.max("_bars").alias("_bars"))
    own, r = F.expr(f"_i div {BLOCK}"), F.col("_i") % BLOCK
    seen = F.array(own, F.when((r < OVERLAP) & (own > 0), own - 1), F.when((r >= BLOCK - OVERLAP) & ((own + 1) * BLOCK < F.col("_bars")), own + 1))
    t = t.select("_s", "_i", "last", own.alias("_own"), F.explode(F.array_compact(seen)).alias("_block"))
    here = F.when(F.col("_own") == F.col("_block"), F.struct("_i", "last"))
    t = t.groupBy("_s", "_block").agg(F.collect_list("_i").alias("_idx"), F.collect_list("last").alias("_val"), F.min(here).alias("_a"), F.max(here).alias("_z"))
    blocks = s.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_bars - 1) div {BLOCK})")))
    blocks = blocks.withColumn("_n", F.least(F.lit(BLOCK), F.col("_bars") - F.col("_block") * BLOCK).cast("int"))
    w = Window.partitionBy("_s").orderBy("_block")
    prior, later = F.last("_z", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("_a", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = blocks.join(t, ["_s", "_block"], "left").withColumns({"_prev": prior, "_next": later}).select("_s", "_first", "_n", "_bar", "_bars", "_block", "_idx", "_val", "_prev", "_next")
    return rows.mapInArrow(_fill, "session_id long, bar_start long, value double, filled boolean, settled boolean")
