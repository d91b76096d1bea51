import itertools
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from tickloom.functions import scalars
from tickloom.operators import asof, bars, fragments, grids, orders, stats
from tickloom.util import iso_micros, materialize


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("2026-01-05T08:02:30.5Z", 1767600150500000), ("2026-01-05 08:02:30", 1767600150000000), (" 20260105T080230+0100 ", 1767596550000000), ("2026-01-05T08:02:30.123456-05:30", 1767619950123456),
     ("2026-02-30T00:00:00Z", None), ("2026-01-05T24:00:00Z", None), ("soon", None), (None, None), ("", None)],
)
def test_iso_micros(spark, text, want):
    assert one(spark, iso_micros(F.lit(text).cast("string"))) == want


def test_scalar_rules(spark):
    df = spark.createDataFrame([("14", 1), ("14.0", 1), ("14.5", 1), ("nan", 1), ("1e30", 1), (None, 1)], "s string, n int")
    assert [r[0] for r in df.select(scalars.strict_int(F.col("s"))).collect()] == [14, 14, None, None, None, None]
    assert [one(spark, scalars.truth(F.lit(x))) for x in ("Yes", " 0 ", "maybe")] == [True, False, None]
    assert [one(spark, scalars.session_day(F.lit(x))) for x in ("20260105", "2026-01-05", "2026-1-5")] == [date(2026, 1, 5), date(2026, 1, 5), None]
    assert [one(spark, scalars.next_weekday(F.lit(date(2026, 1, d)))) for d in (8, 9, 10, 11)] == [date(2026, 1, 9), date(2026, 1, 12), date(2026, 1, 12), date(2026, 1, 12)]
    assert one(spark, scalars.to_increment(F.lit(1.0300000000000002), F.lit(0.01), True)) == 1.03 and one(spark, scalars.to_increment(F.lit(1.039), F.lit(0.01), False)) == 1.03
    e = lambda a, m: tuple(one(spark, scalars.effective_pct(F.lit(a).cast("double"), F.lit(m), F.lit(0.2), F.lit(1.0))))
    assert [e(0.5, 1.5), e(None, 1.5), e(0.1, 2.0), e(2.0, 2.0), e(2.0, 0.0)] == [(0.75, "raw"), (None, "unavailable"), (0.2, "min"), (1.0, "max"), (0.0, "zero")]
    # By hand from the rules: the unrounded multiple decides, equality is held, no ATR below zero; never less than a step.
    assert [e(1.0, 0.204), e(1.0, 0.2), e(0.0, 1.0), e(-1.0, 1.0), e(1.0, 0.996)] == [(0.2, "raw"), (0.2, "min"), (None, "unavailable"), (None, "unavailable"), (1.0, "raw")]
    grid = lambda v, step, up=False: one(spark, scalars.to_increment(F.lit(v), F.lit(step).cast("double"), up))
    assert [grid(0.01, 0.05), grid(1.234, None), grid(1.231, 0.0, True), grid(2.00013, 0.0001, True), grid(7.3, 0.25)] == [0.05, 1.23, 1.24, 2.0002, 7.25]
    assert [one(spark, scalars.connectivity(F.lit(None).cast("int"), F.lit(n))) for n in ("GATEWAY_CONNECTION_FAILED", "Gateway_Connected", "tick")] == ["loss", "restored", "other"]
    assert one(spark, scalars.safe_name(F.lit("x" * 90 + "a"))) != one(spark, scalars.safe_name(F.lit("x" * 90 + "b")))
    assert one(spark, scalars.csv_safe(F.lit(" =x"))) == "' =x" and one(spark, scalars.safe_name(F.lit(" ../a b? "))) == "a_b"
    assert [one(spark, scalars.block_length(F.lit(n))) for n in (14, 29, 59, 60, 91, 92, 1000)] == [None, 2, 3, 4, 4, 5, 5]


def test_hash_index_equals_python(spark):
    import hashlib

    for r, k, n in [(0, 0, 7), (5, "x", 1000), (199, 31, 2**31 - 1)]:
        assert one(spark, scalars.hash_index(F.lit(1), F.lit(r), F.lit(k), F.lit(n))) == int.from_bytes(hashlib.sha256(f"1|{r}|{k}".encode()).digest()[:8], "big") % n


def test_asof_and_ranges_against_brute_force(spark):
    r = random.Random(7)
    left = [(i, r.choice(["a", "a", "b", None]), r.randrange(0, 4000)) for i in range(200)]
    right = [(r.choice(["a", "a", "b"]), r.randrange(0, 4000), i, float(i)) for i in range(300)]
    L, R = spark.createDataFrame(left, "id int, e string, t long"), spark.createDataFrame(right, "e string, t long, o int, v double")
    got = {x.id: x.m.v if x.m else None for x in asof.asof_backward(L, R, ["e"], ["v"], 60, 100).collect()}
    want = {i: max(((t, o, v) for e2, t, o, v in right if e2 == e and t0 - 60 <= t <= t0), default=(0, 0, None))[2] for i, e, t0 in left}
    assert got == want
    pairs = {(x.id, x.o) for x in asof.forward_range(L, R, ["e"], 150, 100).collect()}
    assert pairs == {(i, o) for i, e, t0 in left for e2, t, o, _ in right if e == e2 and t0 < t <= t0 + 150}
    iv = spark.createDataFrame([("a", 10, 1500, "x"), ("a", 1400, 1400, "y"), ("b", 0, 3999, "z")], "e string, lo long, hi long, name string")
    assert {(x.id, x.name) for x in asof.interval_join(L, iv, ["e"], 100).collect()} == {(i, n) for i, e, t in left for e2, a, b, n in [("a", 10, 1500, "x"), ("b", 0, 3999, "z")] if e == e2 and a <= t < b}


def test_tick_atr_against_a_fold(spark):
    r = random.Random(3)
    rows, ns, price = [], 0, 50.0
    for i in range(400):
        ns += r.randrange(1, 40) * 10**9
        price = max(1.0, price + r.gauss(0, 0.3))
        rows.append((1, i, i, ns, round(price, 2) if r.random() < 0.9 else None))
    period, bar = 3, 60
    want, hist = {}, []
    for _, tid, _, ns, p in rows:
        if p is None:
            continue
        b = ns // (bar * 10**9)
        if hist and hist[-1][0] == b:
            h = hist[-1]
            h[1], h[2], h[3], h[4] = max(h[1], p), min(h[2], p), p, ns
        else:
            hist.append([b, p, p, p, ns])
        last = hist[-period - 1 :]
        ok = len(last) == period + 1 and last[0][4] >= ns - max((period + 4) * bar, 300) * 10**9
        tr = [max(y[1] - y[2], abs(y[1] - x[3]), abs(y[2] - x[3])) for x, y in zip(last, last[1:])]
        want[tid] = sum(tr) / period / p * 100 if ok and sum(tr) > 0 else None
    got = {x.tick_id: x.atr_pct for x in bars.tick_atr(spark.createDataFrame(rows, "session_id long, tick_id long, sequence long, elapsed_ns long, price double"), period, bar).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or math.isclose(got[k], want[k], rel_tol=1e-9)) for k in want)
    assert sum(v is not None for v in want.values()) > 100


def test_fragment_choice_is_the_best_disjoint_set():
    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(0, 8)
        s = [r.randrange(0, 30) for _ in range(n)]
        e = [x + r.randrange(1, 12) for x in s]
        got = fragments.schedule(s, e, list(range(n)))
        ok = lambda c: all(e[i] < s[j] or e[j] < s[i] for i, j in itertools.combinations(c, 2))
        best = max((sum(e[i] - s[i] for i in c), -k) for k in range(n + 1) for c in itertools.combinations(range(n), k) if ok(c))
        assert ok(got) and (sum(e[i] - s[i] for i in got), -len(got)) == best


def test_pareto_and_survival(spark):
    r = random.Random(9)
    pts = [(i, r.randrange(6) * 1.0, r.randrange(6) * 1.0, r.randrange(6) * 1.0) for i in range(300)] + [(999, None, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "k int, a double, b double, c double")
    dom = lambda y, x: y[1] >= x[1] and y[2] >= x[2] and y[3] <= x[3] and y[1:] != x[1:]
    assert {x.k for x in stats.pareto_front(df, "k", ["a", "b"], ["c"]).collect()} == {x[0] for x in pts[:-1] if not any(dom(y, x) for y in pts[:-1])}
    km = stats.kaplan_meier(spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 2, True), ("g", 3, True), ("g", None, True)], "g string, duration long, event boolean"), ["g"])
    assert [(x.duration, x.at_risk, round(x.survival, 9)) for x in km.orderBy("duration").collect()] == [(1, 4, 0.75), (2, 3, 0.5), (3, 1, 0.0)]


def test_block_indices_folds_and_cross_fit(spark):
    rows = stats.block_indices(spark, "s", 3, 10, 4).collect()
    assert len(rows) == 30 and all(0 <= x.unit < 10 for x in rows)
    by = {(x.rep, x.pos): x.unit for x in rows}
    assert all((by[rep, p] + 1) % 10 == by[rep, p + 1] for rep in range(3) for p in range(9) if p % 4 != 3)
    import hashlib  # the starts as the stream is defined

    stream = hashlib.shake_256(b"market-replay-moving-block-v1|s|3|10|4").digest(72)
    assert [by[i // 3, i % 3 * 4] for i in range(9)] == [int.from_bytes(stream[8 * i : 8 * i + 8], "big") % 10 for i in range(9)]
    assert [(len(a), list(b)) for a, b in stats.walk_forward(9, 3, 2)] == [(3, [3, 4]), (5, [5, 6]), (7, [7, 8])]
    days = spark.createDataFrame([("k", date(2026, 1, d), 10, c) for d, c in ((1, 2.0), (2, 4.0), (3, 6.0))], "key string, day date, n long, cost double")
    got = [x.assumed for x in orders.cross_fitted(days, 20, 1.0).orderBy("day").collect()]
    assert got == [5.0, 4.0, 3.0]


def test_medians_over_days(spark):
    import random
    from statistics import median

    r = random.Random(3)
    rows = [(g, date(2026, 1, 1 + r.randrange(d)), float(r.randrange(-40, 60))) for g, d, n in (("a", 9, 200), ("b", 3, 30), ("c", 2, 9), ("e", 20, 41)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("a", date(2026, 1, 1), None)], "g string, day date, value double")
    got = {x.g: x for x in stats.leave_one_day_out(df, ["g"]).collect()}
    boot = {x.g: x for x in stats.day_bootstrap(df, ["g"], 7, 60).collect()}
    for g in ("a", "b", "e"):
        days = sorted({d for k, d, _ in rows if k == g})
        v = {d: [x for k, e, x in rows if k == g and e == d] for d in days}
        full = median([x for d in days for x in v[d]])
        est = {d: median([x for e in days if e != d for x in v[e]]) for d in days}
        far = max(days, key=lambda d: (abs(est[d] - full), -d.toordinal()))
        turned = sum(1 for e in est.values() if e and full and (e > 0) != (full > 0))
        assert (got[g].days, got[g].lowest, got[g].middle, got[g].highest, got[g].sign_reversals, got[g].influential_day) == (len(days), min(est.values()), median(est.values()), max(est.values()), turned, far)
        reps = []
        for rep in range(60):
            import hashlib

            draw = [days[int.from_bytes(hashlib.sha256(f"7|{rep}|{i}".encode()).digest()[:8], "big") % len(days)] for i in range(len(days))]
            reps.append(median([x for d in draw for x in v[d]]))
        assert boot[g].median == full and boot[g].positive == sum(m > 0 for m in reps) / 60
    assert "c" not in got and "c" not in boot
    km = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, False), ("g", 4.0, True), ("h", 1.0, True), ("h", 2.0, False), ("k", 3.0, True), ("k", -1.0, True)], "g string, duration double, event boolean")
    assert {x.g: x.probability and round(x.probability, 9) for x in stats.horizon_probability(km, ["g"], 3.0).collect()} == {"g": 33.333333333, "h": None, "k": 100.0}


def test_ranks_of_days_left_out_are_not_broadcast(spark):
    """They are as many as the values, however few days there are."""
    df = spark.range(3000).selectExpr("'a' as g", "date_add(date'2026-01-01', cast(id % 5 as int)) as day", "cast(hash(id) as double) as value")
    got = stats.leave_one_day_out(df, ["g"])
    assert got.count() == 1 and got.collect()
    lines = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            for y in lines[i + 1 :]:
                if depth(y) <= depth(x):
                    break
                assert "Generate" not in y, "\n".join(lines)


def test_draws_and_values_of_medians_over_days_are_not_broadcast(spark):
    """Their files are far smaller than their rows in memory, so a threshold on files' sizes sends too much to the driver."""
    df = materialize(spark.range(3000).selectExpr("'a' as g", "date_add(date'2026-01-01', cast(id % 5 as int)) as day", "cast(hash(id) as double) as value"))
    for got in (stats.day_bootstrap(df, ["g"], 7, 60), stats.leave_one_day_out(df, ["g"])):
        assert len(got.collect()) == 1
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, plan


def test_grid_product_collapse_and_regions(spark):
    g = grids.product(spark, {"a": [1.0, 1.25, 3.0], "b": [0.0, 0.25]})
    assert g.count() == 6
    g = g.withColumn("score", F.when(F.col("a") == 3, 99.0).otherwise(100.0))
    r = {(x.a, x.b): x.region for x in grids.near_best_regions(g, ["a", "b"], "score", 0.25, members=2).collect()}
    assert r == {(1.0, 0.0): 0, (1.0, 0.25): 0, (1.25, 0.0): 0, (1.25, 0.25): 0, (3.0, 0.0): 1, (3.0, 0.25): 1}
    assert {(x.a, x.b, x.centre) for x in grids.near_best_regions(g, ["a", "b"], "score", 0.25).collect()} == {(1.0, 0.0, True), (1.0, 0.25, False), (1.25, 0.0, False), (1.25, 0.25, False)}
    seed = spark.createDataFrame([(0.25, 0.0, 1.0, 0.25, 7)], "initial_x double, buy_x double, profit_x double, sell_x double, other int")
    fine = grids.refined_grid(seed).collect()
    assert len(fine) == 2 * 2 * 3 * 3 and {x.initial_x for x in fine} == {0.25, 0.5} and {x.sell_x for x in fine} == {0.0, 0.25, 0.5} and {x.other for x in fine} == {7}
    probes = grids.boundary_probes(grids.coarse_grid(spark).drop("min_pct"), spark.createDataFrame([(2.25, 0.0, 1.0, 1.25)], "initial_x double, buy_x double, profit_x double, sell_x double")).collect()
    assert {tuple(x) for x in probes} == {(2.5, 0.0, 1.0, 1.25), (2.25, 0.0, 1.0, 1.5)}
    runs = spark.createDataFrame([("k", i, v) for i, v in ((1, 10.0), (2, 9.0), (3, 9.5), (5, 9.9), (6, 9.9), (7, 1.0))], "k string, step long, score double")
    assert [tuple(x) for x in grids.near_best_runs(runs, ["k"], "step", "score", 3).collect()] == [("k", 1, 3, 3, 2, 10.0, 9.0)]
    p = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("c", 2, 5)], "k string, x int, y int")
    assert {(x.k, x.leader) for x in grids.collapse(p, "k", ["x", "y"]).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_connectivity_hours_and_settings(spark):
    df = spark.createDataFrame([(1100, None), (2104, "x"), (5, "Broker_Disconnected"), (None, "reconnected"), (None, None)], "c int, n string")
    assert [r[0] for r in df.select(scalars.connectivity(F.col("c"), F.col("n"))).collect()] == ["loss", "restored", "loss", "restored", "other"]
    hours = spark.range(1).select(scalars.trading_hours(F.lit("20260105:0930-20260105:1600;20260106:CLOSED;20260199:0930-20260199:1600; 20260707:0930-20260707:1600"), F.lit("America/New_York")).alias("h"))
    assert [tuple(r) for r in hours.selectExpr("inline(h)").selectExpr("unix_seconds(open)", "unix_seconds(close)").collect()] == [(1767623400, 1767646800), (1783431000, 1783454400)]
    assert [one(spark, scalars.json_setting(F.lit(x).cast("string"))) for x in ('"a"', "1.5", "true", '{"b": [1]}', "plain text", None)] == ["a", "1.5", "true", '{"b":[1]}', "plain text", None]


def test_exact_rounding_and_grid_axis(spark):
    from tickloom.functions import udfs

    xs = [2.675, 0.125, 0.375, -1.005, None, 1e300]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    assert [r[0] for r in df.select(udfs.exact_round(F.col("v"), 2)).collect()] == [None if x is None else round(x, 2) for x in xs]
    udfs.register(spark)
    assert [tuple(r) for r in spark.sql("select * from grid_axis(0.1D, 0.5D, 0.1D)").collect()] == [(0, 0.1), (1, 0.2), (2, 0.3), (3, 0.4), (4, 0.5)]
    assert spark.sql("select * from grid_axis(1D, 0D, 0.1D)").collect() == [] and spark.sql("select * from grid_axis(1D, 2D, 0D)").collect() == []


def test_order_checks_over_slice_borders(spark, monkeypatch):
    from datetime import datetime, timezone

    from tickloom.operators import quotes

    r = random.Random(12)
    rows, seq, us = [], 0, 0
    for i in range(300):
        seq += r.choice([1, 1, 1, 1, 3])
        us += r.choice([5, 5, 5, -3])
        rows.append((1 + i % 2 * 0, i, seq, datetime.fromtimestamp(1767600000 + us, timezone.utc), us * 10**9))
    rows += rows[40:60]
    df = spark.createDataFrame(rows, "session_id long, tick_id long, sequence long, captured_at_utc timestamp, elapsed_ns long")
    u = sorted(set(rows), key=lambda x: x[2])
    want = (1, 300, sum(b[2] != a[2] + 1 for a, b in zip(u, u[1:])), sum(b[3] < a[3] for a, b in zip(u, u[1:])), sum(b[4] < a[4] for a, b in zip(u, u[1:])))
    for size in (7, 50, 100_000):
        monkeypatch.setattr(quotes, "CHECK_SLICE", size)
        assert [tuple(x) for x in quotes.order_checks(df).collect()] == [want]


def test_compression_does_not_depend_on_slices(spark, monkeypatch):
    from datetime import datetime, timezone

    from tickloom.operators import quotes

    r = random.Random(21)
    rows, us = [], 0
    for i in range(400):
        us += r.choice([0, 200_000, 400_000, 30_000_000])
        q = r.choice([10.0, 10.0, 10.0, 10.01])
        rows.append((1 + i % 2, i, i, datetime.fromtimestamp(1767600000 + us / 1e6, timezone.utc), us * 1000, r.choice([q, q, q, None]), q + 0.02, None, None, r.choice([q, q, None]), 1, r.choice(["bid", "bid", "bid", "last", ""])))
    df = spark.createDataFrame(rows, "session_id long, tick_id long, sequence long, captured_at_utc timestamp, elapsed_ns long, bid double, ask double, last double, close double, mark_price double, market_data_type int, changed_fields string")
    t = quotes.with_prices(df)
    seen = []
    for size in (10**15, 60 * 10**9, 10**9):
        monkeypatch.setattr(quotes, "COMPRESS_SLICE", size)
        seen.append(sorted(x.tick_id for x in quotes.compress(t).collect()))
    assert seen[0] == seen[1] == seen[2] and 150 < len(seen[0]) < 400
    prices = {x.tick_id: x for x in t.collect()}
    for session in (1, 2):
        mine, kept, sig, sec = [x for x in rows if x[0] == session], [], None, None
        for i, x in enumerate(mine):
            p = prices[x[1]]
            now, s = (p.vbid, p.vask, p.price, p.market_data_type), (x[4] // 10**9 if p.price is not None else None)
            if i in (0, len(mine) - 1) or p.full_snapshot or p.last_event or now != sig or (s is not None and s != sec):
                kept.append(x[1])
                sig, sec = now, s if s is not None else sec
        assert kept == [k for k in seen[0] if k % 2 == session - 1]
