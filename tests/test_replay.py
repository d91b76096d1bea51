import math
import random

from tickloom.operators import replay
from tickloom.operators.replay import Rules, Setting

SCHEMA = (
    "con_id long, chain int, session_id long, open_us long, close_us long, us long, elapsed_ns long, sequence long, price double, vbid double, vask double, bid_size double, ask_size double, "
    "last double, last_event boolean, bid_event boolean, ask_event boolean, mark_price double, atr_pct double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
S = 1_000_000


def pct(atr, m, s, zero=False):
    if zero and m <= 0:
        return 0.0
    return round(min(max(atr * m, s.low), s.high), 2)


def up(v):
    return round(max(0.01, math.ceil(v / 0.01 - 1e-12) * 0.01), 8)


def down(v):
    return round(max(0.01, math.floor(v / 0.01 + 1e-12) * 0.01), 8)


def story(sessions, s, r):
    """The same rules told the other way round: the life of one order after the other, walking along the rows of a chain."""
    trades, results, pos, capital = [], [], None, 1.0
    for n, rows in enumerate(sessions):
        start = pos["equity"] if pos else capital
        count, opened, i, anchor, ready, pending, close_us, open_us = 0, 0, 0, None, False, False, rows[0]["close_us"], rows[0]["open_us"]
        carried_in, mark = pos is not None, None
        if pos:
            pos["guard"] = None
        wait = None  # a triggered order that has no quote yet

        def value(x):
            nonlocal mark
            if x["vbid"] is not None:
                mark = x["vbid"]
                pos["equity"] = capital * mark * (1 - r.cost) / pos["basis"]

        def guard(x):
            w = s.protect_value if s.protect == "manual" else pct(x["atr_pct"] or atr, s.protect_value, s) if s.protect == "atr" and (x["atr_pct"] or atr) else None
            if w is not None:
                low = min(v for v in (pos["buy"], x["price"], x["vbid"], x["last"], x["mark_price"]) if v is not None)
                pos.update(guard=down(low * (1 - w / 100)), gp=w, gh=x["last"] or x["price"] or pos["buy"], gs=x["sequence"])

        def buy(x, ref):
            """True once the order is done with, filled or given up."""
            nonlocal pos, opened, anchor
            if x["vask"] is None:
                return False
            fill = max(ref, x["vask"])
            if r.notional < fill:
                anchor = None
                return True
            pos = {"buy": fill, "basis": fill * (1 + r.cost), "us": x["us"], "equity": capital, "guard": None, "sale": None, "qty": int(r.notional / fill)}
            opened += 1
            guard(x)
            value(x)
            return True

        def sell(x, ref, why):
            nonlocal pos, capital, count, ready, mark
            if x["vbid"] is None:
                return False
            fill = min(ref, x["vbid"])
            capital = capital * fill * (1 - r.cost) / pos["basis"]
            trades.append((pos["us"], x["us"], pos["buy"], fill, pos["qty"], why))
            count, pos, ready, mark = count + 1, None, False, None
            return True

        order = None  # the resting buy stop
        for x in rows:
            atr = x["atr_pct"] if x["atr_pct"] is not None else (atr if n or i else None)
            i += 1
            if wait:
                kind, ref, why = wait
                if kind == "sell":
                    value(x)
                if buy(x, ref) if kind == "buy" else sell(x, ref, why):
                    wait = None
                continue
            if x["price"] is None:
                if pos:
                    value(x)
                continue
            p, moved = x["price"], x["last_event"] and x["last"] is not None
            enter = open_us + r.entry_delay_s * S <= x["us"] <= close_us - r.entry_cutoff_s * S
            if pos:
                value(x)
                sale = pos.get("sale")
                if sale:
                    if moved and x["sequence"] > sale["seq"]:
                        sale["high"] = max(sale["high"], x["last"])
                        sale["stop"] = max(sale["stop"], down(sale["high"] * (1 - sale["trail"] / 100)))
                        if x["last"] <= sale["stop"] and not sell(x, x["last"], "trail"):
                            wait = ("sell", x["last"], "trail")
                    continue
                if pos["guard"] is None and s.protect != "off":
                    guard(x)
                elif pos["guard"] is not None and moved and x["sequence"] > pos["gs"]:
                    pos["gh"] = max(pos["gh"], x["last"])
                    pos["guard"] = max(pos["guard"], down(pos["gh"] * (1 - pos["gp"] / 100)))
                    if x["last"] <= pos["guard"]:
                        if not sell(x, x["last"], "protective"):
                            wait = ("sell", x["last"], "protective")
                        continue
                if x["atr_pct"] is None:
                    continue
                least, trail = pos["buy"] * (1 + pct(x["atr_pct"], s.profit, s) / 100), pct(x["atr_pct"], s.trail, s, True)
                if trail <= 0:
                    if p >= least and not sell(x, p, "profit"):
                        wait = ("sell", p, "profit")
                elif trail < 100 and p >= least / (1 - trail / 100):
                    stop = down(min(v for v in (p, x["vbid"], x["last"], x["mark_price"]) if v is not None) * (1 - trail / 100))
                    if stop >= up(least):
                        pos["sale"], pos["guard"] = {"seq": x["sequence"], "high": x["last"] or p, "stop": stop, "trail": trail}, None
            elif order:
                if x["us"] >= close_us - r.cancel_s * S:
                    order, anchor = None, None
                elif moved and x["sequence"] > order["seq"]:
                    order["low"] = min(order["low"], x["last"])
                    order["stop"] = min(order["stop"], up(order["low"] * (1 + order["back"] / 100)))
                    if x["last"] >= order["stop"]:
                        order = None
                        if not buy(x, x["last"]):
                            wait = ("buy", x["last"], "")
            elif not ready:
                if enter and x["atr_pct"] is not None:
                    ready, anchor = True, p
            elif enter and x["atr_pct"] is not None:
                anchor = p if anchor is None else max(anchor, p)
                if p <= anchor * (1 - pct(x["atr_pct"], s.initial, s) / 100):
                    back = pct(x["atr_pct"], s.rebound, s, True)
                    if back <= 0:
                        if not buy(x, p):
                            wait = ("buy", p, "")
                    else:
                        order = {"seq": x["sequence"], "low": x["last"] or p, "back": back, "stop": up(max(v for v in (p, x["vask"], x["last"], x["mark_price"]) if v is not None) * (1 + back / 100))}
        carried = pos is not None and n + 1 < len(sessions) and r.carry and mark is not None
        if pos:
            pos["sale"] = None
        end = pos["equity"] if carried else min(capital, pos["equity"]) if pos else capital
        results.append((count, opened, carried_in, carried, pos is not None and not carried, round((end / start - 1) * 1e4, 6)))
        if pos and not carried:
            if mark is not None:
                trades.append((pos["us"], rows[-1]["us"], pos["buy"], mark, pos["qty"], "open"))
            else:
                trades.append((pos["us"], rows[-1]["us"], pos["buy"], None, pos["qty"], "open"))
            capital, pos = end, None
    return trades, results


def chain(seed, con, number, sessions=3, n=500):
    r = random.Random(seed)
    out, price, seq = [], 20.0, 0
    for k in range(sessions):
        open_us = (1_767_600_000 + 86_400 * k) * S
        rows = []
        for i in range(n):
            seq += 1
            price *= 1 + r.gauss(0, 0.002)
            some = lambda v, q=0.03: None if r.random() < q else round(v, 2)
            us = open_us + i * 9 * S
            rows.append(dict(zip(NAMES, (con, number, 10 * con + k, open_us, open_us + n * 9 * S, us, (us - open_us) * 1000 + k * 10**14, seq, some(price), some(price - 0.01, 0.1), some(price + 0.01, 0.1), some(300.0, 0.2), some(300.0, 0.2),
                                         some(price + r.choice([-0.01, 0, 0.01]), 0.1), r.random() < 0.7, True, True, some(price, 0.3), None if i < 20 or r.random() < 0.02 else 0.3))))
        out.append(rows)
    return out


SETTINGS = {
    "control": Setting(1.5, 0.75, 1.0, 1.0), "same": Setting(1.5, 0.75, 1.0, 1.0), "at once": Setting(1.0, 0.0, 1.0, 0.0), "guarded": Setting(1.0, 0.5, 3.0, 1.0, protect="atr", protect_value=2.0),
    "manual": Setting(0.5, 0.5, 2.0, 0.0, protect="manual", protect_value=0.4), "held": Setting(9.0, 0.1, 0.1, 9.0, low=0.3, high=0.6), "rare": Setting(30.0, 1.0, 1.0, 1.0),
}


def test_against_the_same_rules_told_order_by_order(spark):
    chains = [chain(1, 1, 1), chain(2, 2, 1, sessions=1), chain(3, 3, 4, sessions=4)]
    for rules in (Rules(), Rules(carry=False, notional=15.0)):
        df = spark.createDataFrame([tuple(x.values()) for c in chains for rows in c for x in rows], SCHEMA).repartition(7)
        sessions, trades = replay.replay(df, SETTINGS, rules, batch=3)
        got_s = {(x.profile, x.session_id): (x.trades, x.opened, x.carried_in, x.carried_out, x.terminal_open, round(x.conservative_bps, 6)) for x in sessions.collect()}
        got_t = sorted((x.profile, x.con_id, x.bought_us, x.sold_us, x.buy_price, x.sell_price, x.quantity, x.reason) for x in trades.collect())
        want_s, want_t = {}, []
        for name, s in SETTINGS.items():
            for c in chains:
                t, res = story(c, s, rules)
                want_s |= {(name, rows[0]["session_id"]): x for rows, x in zip(c, res)}
                want_t += [(name, c[0][0]["con_id"], *x) for x in t]
        assert got_t == sorted(want_t)
        assert got_s == want_s
        assert {t[-1] for t in want_t} >= ({"trail", "profit", "protective", "open"} if rules.carry else {"open"}) or rules.notional < 20


def test_held_percentages_are_counted_once_a_second_and_touches_without_size_are_thin(spark):
    rows = [x for x in chain(5, 1, 1, sessions=1)[0]]
    twice = [x | {"sequence": 2 * x["sequence"], "us": x["us"] + k, "elapsed_ns": x["elapsed_ns"] + k} for x in rows for k in (0, 1000)]
    one = lambda some: replay.replay(spark.createDataFrame([tuple(x.values()) for x in some], SCHEMA), {"rare": SETTINGS["rare"]})[0].collect()[0]
    a, b = one(rows), one(twice)
    clamps = lambda x: x.clamp_raw + x.clamp_min + x.clamp_max + x.clamp_zero
    assert 0 < clamps(a) <= clamps(b) <= clamps(a) + 2  # the second row of the anchor's second counts, too
    s = replay.replay(spark.createDataFrame([tuple((x | {"ask_size": None}).values()) for x in rows], SCHEMA), {"at once": SETTINGS["at once"]})[0].collect()[0]
    assert s.thin_touches >= s.opened > 0
    old = replay.replay(spark.createDataFrame([tuple((x | {"bid_event": i == 0, "ask_event": i == 0}).values()) for i, x in enumerate(rows)], SCHEMA), {"at once": SETTINGS["at once"]}, Rules(quote_age_s=5.0))[0].collect()[0]
    assert old.opened == 0 and old.right_censored  # the order still waits for a fresh quote


def test_empty_and_summary(spark):
    sessions, trades = replay.replay(spark.createDataFrame([], SCHEMA), SETTINGS)
    assert sessions.collect() == [] and trades.collect() == [] and replay.summarize(sessions).collect() == [] and replay.chain_economics(sessions).collect() == []
    df = spark.createDataFrame([tuple(x.values()) for rows in chain(7, 1, 1) for x in rows], SCHEMA)
    sessions = replay.replay(df, SETTINGS)[0]
    rows = {r.profile: r for r in replay.summarize(sessions).collect()}
    assert rows.keys() == SETTINGS.keys() and rows["same"].asDict() | {"profile": ""} == rows["control"].asDict() | {"profile": ""}
    assert {r.sessions for r in replay.chain_economics(sessions).collect()} == {3}


def test_replay_runs_once_for_pairs_and_shuffles_readings_once(spark, monkeypatch):
    """Batches of settings share one shuffle of the readings, and the pairs with the control one replay."""
    from tickloom.plans import replay_queries
    from tickloom.util import materialize

    n = 0

    def counted(df):
        nonlocal n
        n += "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df)

    monkeypatch.setattr(replay_queries, "materialize", counted)
    p = replay_queries._pairs(spark, "/root/testdata/sf0.001")
    assert n == 1 and "MapInArrow" not in p._jdf.queryExecution().optimizedPlan().toString()
    s = replay.replay(replay_queries.readings(spark, "/root/testdata/sf0.001"), SETTINGS, batch=2)[0]
    assert s.collect()
    plan = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    batches = plan.count("MapInArrow")
    assert batches == -(-len(set(SETTINGS.values())) // 2) > 1 and plan.count("ReusedExchange") == batches - 1, plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
