import random
from datetime import datetime, timedelta, timezone

import pytest
from tickloom.operators.spikes import flag_readings

SCHEMA = "tick_id long, session_id long, captured_at_utc timestamp, bid double, ask double, last double, mark_price double, changed_fields string, field string"
T0 = datetime(2026, 1, 5, 8, tzinfo=timezone.utc)


def walk(session, n, seed, start_id=0, price=50.0, step=10, vol=0.0004):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        price *= 1 + r.gauss(0, vol)
        s = 0.01 * r.randrange(1, 5)
        rows.append([start_id + i, session, T0 + timedelta(seconds=step * i), round(price - s, 2), round(price + s, 2), round(price + r.choice([-s, 0, s]), 2), round(price, 2), "", "x"])
    return rows


def run(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    got = [(r.tick_id, r.field, r.rule) for r in flag_readings(df).collect()]
    assert len(got) == len({g[:2] for g in got})
    return {(t, f): rule for t, f, rule in got}


def test_planted_cases_and_nothing_else(spark):
    rows = walk(1, 900, 1) + walk(2, 700, 2, 10_000, price=9.0)
    want = {}
    rows[100][3] = -1.0
    want[100, "bid"] = "impossible"
    rows[150][5] = 2147483647.0
    want[150, "last"] = "impossible"
    for i in (200, 201, 202):  # an excursion over three readings
        rows[i][4] = round(rows[i][4] * 1.05, 2)
        want[i, "ask"] = "spike"
    rows[300][3] = round(rows[300][3] * 0.99, 2)
    want[300, "bid"] = "spike"
    for i in range(85, 125):  # stuck over the border of a slice
        rows[i][5] = rows[85][5] if i != 100 else None
        if i > 85 and i != 100:
            want[i, "last"] = "stuck"
    for i in range(400, len(rows)):  # a real move that stays
        if rows[i][1] == 1:
            for k in (3, 4, 5, 6):
                rows[i][k] = round(rows[i][k] * 1.08, 2)
    rows += [list(r) for r in rows[195:205]]  # delivered twice
    got = run(spark, rows)
    assert got == want


def test_lively_and_quiet_sources_have_their_own_limits(spark):
    rows = walk(1, 600, 5, vol=0.00005) + walk(2, 600, 6, 10_000, vol=0.004)
    assert run(spark, rows) == {}
    rows[50][5] = round(rows[50][5] + 0.6, 2)
    assert run(spark, rows) == {(50, "last"): "spike"}


def test_the_tail_of_a_wide_quote_is_that_of_its_own_noise(spark):
    rows = walk(1, 600, 7) + walk(2, 600, 8, 10_000)
    for r in rows:  # half a spread of 40 units that itself moves by two at most
        r[3], r[4] = round(r[3] - 0.38, 2), round(r[4] + 0.38, 2)
    assert run(spark, rows) == {}
    rows[70][3] = round(rows[70][3] - 0.3, 2)
    rows[400][4] = round(rows[400][4] + 0.3, 2)
    assert run(spark, rows) == {(70, "bid"): "spike", (400, "ask"): "spike"}


def test_exceedances_move_a_cutoff_by_degrees(spark):
    from tickloom.operators import spikes

    cut = []
    for k in (6, 7, 8, 9):  # the count of exceedances is no switch
        rows = walk(1, 400, 12)
        for i in range(k):
            rows[20 + 40 * i][3] = round(rows[20 + 40 * i][3] + 0.12, 2)
        th = spikes.thresholds(spikes._base(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)))
        cut.append(max(r.hi_bid for r in th.collect()))
    assert max(b / a for a, b in zip(cut, cut[1:])) < 1.3 and min(b / a for a, b in zip(cut, cut[1:])) > 0.7


def test_order_and_slices_do_not_matter(spark, monkeypatch):
    from tickloom.operators import spikes

    rows = walk(1, 500, 9)
    for i in range(200, 260):
        rows[i][3] = rows[200][3]
    rows[320][5] = 80.0
    got = run(spark, rows)
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(spikes, "SLICE_S", 10_000_000)
    assert run(spark, rows) == got and len(got) == 60


def test_nulls_empty_and_single_rows(spark):
    assert run(spark, []) == {}
    rows = [[1, None, None, None, 0.0, float("inf"), None, None, ""], [None, 1, T0, -1.0, 1.0, 1.0, 1.0, "", ""], [2, 1, T0, 5.0, 5.0, None, 0.0, "bid", ""]]
    assert run(spark, rows) == {(1, "ask"): "impossible", (1, "last"): "impossible"}


def test_spikes_without_a_mark(spark):
    rows = walk(1, 600, 21)
    for r in rows:
        r[6] = None
    for k in (3, 4, 5):
        rows[350][k] = round(5 * rows[350][k], 2)
    assert run(spark, rows) == {(350, f): "spike" for f in ("bid", "ask", "last")}
    rows = walk(1, 600, 22)  # some marks are missing, also that of the spike
    for i in [*range(0, 600, 7), 350]:
        rows[i][6] = None
    rows[350][3] = round(0.9 * rows[350][3], 2)
    got = run(spark, rows)
    assert got.pop((350, "bid")) == "spike"
    assert len(got) <= 1 and all(rows[t][6] is None for t, _ in got)  # of 86 readings without a mark, which are measured less sharply


@pytest.mark.parametrize("n", [17, 40])
def test_stuck_without_reference(spark, n):
    rows = walk(1, 300, 11)
    for r in rows:
        r[6] = None
    for i in range(100, 100 + n):
        rows[i][4] = 50.0
    assert {k for k in run(spark, rows)} == {(i, "ask") for i in range(101, 100 + n)}
