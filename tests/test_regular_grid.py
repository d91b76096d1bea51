from datetime import datetime, timedelta, timezone

import numpy as np
from tickloom.operators import regular_grid
from tickloom.operators.regular_grid import regular_bars, ssa_impute

T0 = datetime(2026, 1, 5, 8, 0, 7, tzinfo=timezone.utc)
TICKS = "tick_id long, session_id long, captured_at_utc timestamp, last double, filled string"
SESSIONS = "session_id long, con_id long, schedule_open_utc timestamp, schedule_close_utc timestamp, value string"
INSTRUMENTS = "con_id long, atr_bar_seconds int"


def run(spark, ticks, sessions, instruments=((9, 30),)):
    at = lambda s: T0 + timedelta(seconds=s) if s is not None else None
    t = spark.createDataFrame([(i, s, at(x), v, "") for i, s, x, v in ticks], TICKS)
    s = spark.createDataFrame([(i, c, at(a), at(b), "") for i, c, a, b in sessions], SESSIONS)
    return sorted(tuple(r) for r in regular_bars(t, s, spark.createDataFrame(list(instruments), INSTRUMENTS)).collect())


def test_bars_marks_and_last_reading(spark):
    base = int(T0.timestamp()) // 30 * 30
    ticks = [(1, 1, 0, 10.0), (2, 1, 5, 11.0), (2, 1, 5, 11.0), (3, 1, 5, 12.0), (4, 1, 60, None), (5, 1, 61, float("nan")), (6, 1, 120, 13.0), (7, 1, 9999, 1.0), (8, 77, 0, 1.0), (9, 1, None, 1.0)]
    got = run(spark, ticks, [(1, 9, 0, 143), (1, 9, 0, 143), (2, 9, 0, None), (3, 8, 0, 10), (4, 9, 5, 5), (None, 9, 0, 10)])
    assert [(r[1] - base, r[3]) for r in got] == [(0, False), (30, True), (60, True), (90, True), (120, False)]
    assert got[0][2] == 12.0 and all(10 <= r[2] <= 14 for r in got)


def test_session_without_readings_and_last_bar_border(spark):
    got = run(spark, [], [(1, 9, 23, 53)])
    assert [(r[2], r[3]) for r in got] == [(None, True)]
    assert run(spark, [], []) == []


def test_blocks_do_not_change_the_grid(spark):
    got = run(spark, [(i, 1, 40 * i, float(i % 7)) for i in range(500)], [(1, 9, 0, 200_000)], ((9, 5),))
    assert len(got) == 40_001 and len({r[1] for r in got}) == len(got)
    assert sum(not r[3] for r in got) == 500 and regular_grid.BLOCK < 40_000


def test_imputation_recovers_a_wave():
    x = np.sin(np.arange(300) / 9) + 0.01 * np.arange(300)
    y = x.copy()
    gone = np.random.default_rng(1).random(300) < 0.2
    y[gone] = np.nan
    out = ssa_impute(y)
    assert np.array_equal(out[~gone], x[~gone]) and np.abs(out[gone] - x[gone]).mean() < 0.03
    assert np.isnan(ssa_impute(np.full(5, np.nan))).all() and ssa_impute(np.array([np.nan, 2.0, np.nan])).tolist() == [2, 2, 2]


def test_imputation_settles_or_says_that_it_did_not():
    r = np.random.default_rng(3)
    y = np.cumsum(r.normal(size=160))
    y[r.random(160) < 0.6] = np.nan
    x, settled = regular_grid.ssa_settle(y)
    again, _ = regular_grid.ssa_settle(np.where(np.isnan(y), np.nan, y), tol=1e-5)
    assert settled and np.abs(x - again).max() < 0.05 * np.nanstd(y)
    assert not regular_grid.ssa_settle(y, tol=-1.0)[1]  # never below: given up, and said so


def test_blocks_without_readings_take_their_neighbours(spark):
    got = run(spark, [(1, 1, 0, 4.0), (2, 1, 60_000, 10.0)], [(1, 9, 0, 100_000)], ((9, 5),))
    assert len(got) == 20_001 and all(r[2] is not None for r in got)
    assert [round(r[2], 1) for r in got[4800:12_001:2400]] == [6.4, 7.6, 8.8, 10.0] and got[-1][2] == 10.0
