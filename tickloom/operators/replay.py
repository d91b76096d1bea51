"""A keyed stateful fold over chains of sessions: trailing-order settings replayed over recorded readings.

Readings are clustered by chain, once for all, and sorted for each batch of settings, then folded while they stream through
the task: a task holds one Arrow batch and the states of one batch of settings, never a chain. Batches spread a hot chain
with many settings over many tasks. Settings that are equal are folded once and their results shared.

One setting is in one stage at a time: ready, waiting for a drop, trailing a buy, buying, holding, trailing a sale, selling.
Within a session's entry hours the first reading with an ATR becomes the anchor; a fall of ``initial`` below the highest
price since starts a buy stop that follows the low of later Last events by ``rebound``. A triggered order waits for a fresh
quote of its side and fills at the worse of its reference and that quote. A position has a protective stop, if the setting
has one, until the price covers profit and trail; then a sale stop follows the high of later Last events. A position may be
carried into the next session of its chain, where it is held anew; otherwise it is closed in the books at the last bid.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import ship

READY, DROP, BUY, BUYING, HOLD, SELL, SELLING = range(7)
SESSIONS = (
    "con_id long, chain int, session_id long, profile string, trades int, opened int, carried_in boolean, carried_out boolean, terminal_open boolean, right_censored boolean, "
    "realized double, marked double, conservative_bps double, drawdown_bps double, turnover double, clamp_raw int, clamp_min int, clamp_max int, clamp_zero int, touches int, thin_touches int"
)
TRADES = "con_id long, chain int, session_id long, profile string, bought_us long, sold_us long, buy_price double, sell_price double, quantity long, reason string, mae_bps double, mfe_bps double"
#: Columns a reading has, in the order of the fold's tuples.
READING = ["con_id", "chain", "session_id", "open_us", "close_us", "us", "elapsed_ns", "sequence", "price", "vbid", "vask", "bid_size", "ask_size", "last", "last_event", "bid_event", "ask_event", "mark_price", "atr_pct"]


@dataclass(frozen=True)
class Setting:
    """Multiples of the ATR%, held between low and high percent; a rebound or trail of zero acts at once. The protective
    stop is off, a percentage (manual) or a multiple of the ATR% at the purchase (atr)."""

    initial: float
    rebound: float
    profit: float
    trail: float
    low: float = 0.01
    high: float = 99.0
    protect: str = "off"
    protect_value: float = 0.0


@dataclass(frozen=True)
class Rules:
    """What holds for all settings: capital per order, cost per side, entry hours, age of a quote, price grid, carrying."""

    notional: float = 10_000.0
    cost: float = 0.0005
    entry_delay_s: float = 300.0
    entry_cutoff_s: float = 900.0
    cancel_s: float = 300.0
    quote_age_s: float | None = None
    tick: float = 0.01
    carry: bool = True


def held_pct(atr: float, multiple: float, low: float, high: float, zero: bool) -> tuple[float, str]:
    """See ``functions.scalars.effective_pct``; inside the fold."""
    if zero and multiple <= 0:
        return 0.0, "zero"
    raw = atr * multiple
    return (round(low, 2), "min") if raw <= low else (round(high, 2), "max") if raw >= high else (round(raw, 2), "raw")


def on_grid(v: float, tick: float, up: bool) -> float:
    n = math.ceil(v / tick - 1e-12) if up else math.floor(v / tick + 1e-12)
    return round(max(tick, n * tick), 8)


@dataclass
class Book:
    """What one session of one setting adds up to."""

    trades: int = 0
    opened: int = 0
    turnover: float = 0.0
    touches: int = 0
    thin: int = 0
    clamps: Counter = field(default_factory=Counter)


class Machine:
    """One setting's state over the sessions of a chain."""

    def __init__(self, s: Setting, rules: Rules):
        self.s, self.r = s, rules
        self.stage, self.capital, self.equity, self.peak, self.fall = READY, 1.0, 1.0, 1.0, 0.0
        self.anchor = self.mark = None
        self.qty, self.bought_us, self.guard = 0, 0, None
        self.carried = False

    def begin(self, open_us: int, close_us: int) -> None:
        r = self.r
        self.book, self.start, self.carried = Book(), self.capital if self.stage < HOLD else self.equity, self.stage >= HOLD
        self.entry = (open_us + r.entry_delay_s * 1e6, close_us - r.entry_cutoff_s * 1e6)
        self.cancel_us = close_us - r.cancel_s * 1e6
        self.bid_ns = self.ask_ns = self.mark = None
        self.seconds: dict[str, int] = {}
        self.fall, self.peak = 0.0, max(self.peak, self.start)
        if self.stage >= HOLD:  # held anew: percentages and stops are set again
            self.stage, self.guard, self.anchor = HOLD, None, None
        else:
            self.stage, self.anchor = READY, None

    def _pct(self, name: str, atr: float, multiple: float, zero: bool, ns: int) -> float:
        pct, state = held_pct(atr, multiple, self.s.low, self.s.high, zero)
        if self.seconds.get(name) != ns // 1_000_000_000:  # counted once per component and second
            self.seconds[name] = ns // 1_000_000_000
            self.book.clamps[state] += 1
        return pct

    def _value(self, bid: float | None) -> None:
        if bid is not None:
            self.mark, self.equity = bid, self.capital * bid * (1 - self.r.cost) / self.basis
            self.worst, self.best = min(self.worst, bid), max(self.best, bid)
        self._watch()

    def _watch(self) -> None:
        self.peak = max(self.peak, self.equity)
        self.fall = max(self.fall, (self.peak - self.equity) / self.peak)

    def _fresh(self, at: int | None, ns: int) -> bool:
        age = self.r.quote_age_s
        return age is None or (at is not None and ns - at <= age * 1e9)

    def _touch(self, size: float | None) -> None:
        self.book.touches += 1
        self.book.thin += size is None or size < self.qty

    def _buy(self, x: tuple) -> None:
        us, ns, seq, price, bid, ask, _, ask_size, last, mark, atr = x
        if ask is None or not self._fresh(self.ask_ns, ns):
            self.stage = BUYING
            return
        fill = max(self.ref, ask)
        self.qty = int(self.r.notional / fill)
        if not self.qty:
            self.stage, self.anchor = DROP, None
            return
        self._touch(ask_size)
        self.buy, self.basis, self.bought_us, self.stage = fill, fill * (1 + self.r.cost), us, HOLD
        self.worst = self.best = fill
        self.book.opened += 1
        self.book.turnover += 1
        self._protect(x)
        self._value(bid)

    def _protect(self, x: tuple) -> None:
        """Places the protective stop under the purchase and under every price at hand."""
        us, ns, seq, price, bid, ask, _, _, last, mark, atr = x
        s, self.guard = self.s, None
        if s.protect == "manual":
            pct = s.protect_value
        elif s.protect == "atr" and (atr or self.atr):
            pct = held_pct(atr or self.atr, s.protect_value, s.low, s.high, False)[0]
        else:
            return
        under = min(v for v in (self.buy, price, bid, last, mark) if v is not None)
        self.guard_pct, self.guard_high, self.guard_seq = pct / 100, last or price or self.buy, seq
        self.guard = on_grid(under * (1 - self.guard_pct), self.r.tick, False)

    def _sell(self, x: tuple, out: list) -> None:
        us, ns, seq, price, bid, ask, bid_size, _, last, mark, atr = x
        if bid is None or not self._fresh(self.bid_ns, ns):
            self.stage = SELLING
            return
        fill = min(self.ref, bid)
        self._touch(bid_size)
        self.worst, self.best = min(self.worst, fill), max(self.best, fill)
        self.capital = self.equity = self.capital * fill * (1 - self.r.cost) / self.basis
        self._watch()
        self.book.trades += 1
        self.book.turnover += 1
        out.append((self.bought_us, us, self.buy, fill, self.qty, self.reason, (1 - self.worst / self.buy) * 1e4, (self.best / self.buy - 1) * 1e4))
        self.stage, self.anchor, self.guard, self.mark = READY, None, None, None

    atr = None

    def step(self, x: tuple, bid_event: bool, ask_event: bool, event: bool, out: list) -> None:
        us, ns, seq, price, bid, ask, _, _, last, mark, atr = x
        if bid_event:
            self.bid_ns = ns if bid is not None else None
        if ask_event:
            self.ask_ns = ns if ask is not None else None
        if atr is not None:
            self.atr = atr
        s, stage = self.s, self.stage
        if stage == BUYING:
            self._buy(x)
            return
        if stage == SELLING:
            self._value(bid)
            self._sell(x, out)
            return
        if price is None:
            if stage >= HOLD:
                self._value(bid)
            return
        enter = self.entry[0] <= us <= self.entry[1]
        moved = event and last is not None
        if stage == READY:
            if enter and atr is not None:
                self.stage, self.anchor = DROP, price
        elif stage == DROP:
            if not enter or atr is None:
                return
            self.anchor = price if self.anchor is None else max(self.anchor, price)
            drop, back = self._pct("initial", atr, s.initial, False, ns), self._pct("rebound", atr, s.rebound, True, ns)
            if price > self.anchor * (1 - drop / 100):
                return
            if back <= 0:
                self.ref = price
                self._buy(x)
                return
            self.back, self.seq = back / 100, seq
            self.stop = on_grid(max(v for v in (price, ask, last, mark) if v is not None) * (1 + self.back), self.r.tick, True)
            self.low, self.stage = last or price, BUY
        elif stage == BUY:
            if us >= self.cancel_us:
                self.stage, self.anchor = DROP, None
            elif moved and seq > self.seq:
                self.low = min(self.low, last)
                self.stop = min(self.stop, on_grid(self.low * (1 + self.back), self.r.tick, True))
                if last >= self.stop:
                    self.ref = last
                    self._buy(x)
        else:
            self._value(bid)
            if stage == HOLD:
                self._hold(x, moved, out)
            elif moved and seq > self.seq:
                self.high = max(self.high, last)
                self.stop = max(self.stop, on_grid(self.high * (1 - self.back), self.r.tick, False))
                if last <= self.stop:
                    self.ref, self.reason = last, "trail"
                    self._sell(x, out)

    def _hold(self, x: tuple, moved: bool, out: list) -> None:
        us, ns, seq, price, bid, ask, _, _, last, mark, atr = x
        s = self.s
        if self.guard is None and s.protect != "off":
            self._protect(x)
        elif self.guard is not None and moved and seq > self.guard_seq:
            self.guard_high = max(self.guard_high, last)
            self.guard = max(self.guard, on_grid(self.guard_high * (1 - self.guard_pct), self.r.tick, False))
            if last <= self.guard:
                self.ref, self.reason = last, "protective"
                self._sell(x, out)
                return
        if atr is None:
            return
        profit, trail = self._pct("profit", atr, s.profit, False, ns), self._pct("trail", atr, s.trail, True, ns)
        least = self.buy * (1 + profit / 100)
        if trail <= 0:
            if price >= least:
                self.ref, self.reason = price, "profit"
                self._sell(x, out)
            return
        if trail >= 100 or price < least / (1 - trail / 100):
            return
        stop = on_grid(min(v for v in (price, bid, last, mark) if v is not None) * (1 - trail / 100), self.r.tick, False)
        if stop >= on_grid(least, self.r.tick, True):
            self.back, self.stop, self.high, self.seq, self.guard, self.stage = trail / 100, stop, last or price, seq, None, SELL

    def end(self, more: bool, us: int, out: list) -> tuple:
        """Closes a session; ``more`` tells whether the chain goes on."""
        b, is_open = self.book, self.stage >= HOLD
        carried = is_open and more and self.r.carry and self.mark is not None
        terminal, pending = is_open and not carried, self.stage in (BUYING, SELLING)
        realized, marked = self.capital / self.start, self.equity / self.start
        value = marked if carried else min(realized, marked) if terminal else realized
        if terminal:
            out.append((self.bought_us, us, self.buy, self.mark, self.qty, "open", (1 - self.worst / self.buy) * 1e4, (self.best / self.buy - 1) * 1e4))
            self.capital = self.equity = self.start * value
            self.stage = READY
        elif self.stage == BUYING:
            self.stage = READY
        c = b.clamps
        return (b.trades, b.opened, self.carried, carried, terminal, terminal or pending, realized, marked, (value - 1) * 1e4, self.fall * 1e4, b.turnover, c["raw"], c["min"], c["max"], c["zero"], b.touches, b.thin)


def fold_chain(rows: Iterator[tuple], settings: list[tuple[Setting, list[str]]], rules: Rules, sessions: list, trades: list) -> Iterator[None]:
    """Folds rows of READING, sorted by chain, session and clock; yields after each session, when its results are in the lists."""
    key, machines, us = None, [], 0
    head: tuple | None = None

    def close(more: bool) -> None:
        for m, (_, names) in zip(machines, settings):
            out = m.out
            end = m.end(more, us, out)
            for n in names:
                sessions.append((*key, n, *end))
                trades.extend((*key, n, *t) for t in out)
            m.out = []

    for con, chain, session, open_us, close_us, us_now, ns, seq, price, bid, ask, bid_size, ask_size, last, event, bid_event, ask_event, mark, atr in rows:
        if (con, chain, session) != key:
            same = key is not None and (con, chain) == head
            if key is not None:
                close(same)
                yield
            if not same:
                machines = [Machine(s, rules) for s, _ in settings]
                for m in machines:
                    m.out = []
            key, head = (con, chain, session), (con, chain)
            for m in machines:
                m.begin(open_us, close_us)
        us = us_now
        x = (us, ns, seq, price, bid, ask, bid_size, ask_size, last, mark, atr)
        for m in machines:
            m.step(x, bid_event, ask_event, event, m.out)
    if key is not None:
        close(False)
        yield


def replay(readings: DataFrame, profiles: dict[str, Setting], rules: Rules = Rules(), batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows of SESSIONS, rows of TRADES). ``readings`` has READING's columns, ordered within a chain by (open_us,
    session_id, elapsed_ns, sequence). Null prices, sizes and ATRs are allowed; every session with a reading has a row per
    setting. ``batch`` settings go together over one reading of the shuffled rows."""
    ship(readings.sparkSession)
    alike: dict[Setting, list[str]] = {}
    for name, s in profiles.items():
        alike.setdefault(s, []).append(name)
    groups = list(alike.items())
    batches = [groups[i : i + batch] for i in range(0, len(groups), batch)]
    pos = lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c).cast("double")).alias(c)
    d = readings.select(*[pos(c) if c in ("price", "vbid", "vask", "bid_size", "ask_size", "last", "mark_price", "atr_pct") else c for c in READING])
    # One shuffle for all batches: each reads it again and sorts its own share, so a chain's batches are tasks of their own.
    d = d.repartition("con_id", "chain").sortWithinPartitions("con_id", "chain", "open_us", "session_id", "elapsed_ns", "sequence")

    def runner(which: int, schema: str):
        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

        def folded(own: list[tuple[Setting, list[str]]]):
            def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                from tickloom.operators import replay as module

                sessions: list = []
                trades: list = []
                out = (sessions, trades)[which]
                rows = (r for b in got for r in zip(*(b.column(c).to_pylist() for c in READING)))
                for _ in module.fold_chain(rows, own, rules, sessions, trades):
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out.clear()
                    (sessions, trades)[1 - which].clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

            return d.mapInArrow(run, schema)

        return reduce(DataFrame.unionAll, [folded(own) for own in batches or [[]]])

    return runner(0, SESSIONS), runner(1, TRADES)


def summarize(sessions: DataFrame) -> DataFrame:
    """Per setting: sessions, trades, shares of sessions that end open, carried or censored, median, mean and worst
    conservative return, share of sessions with a gain, largest drawdown, turnover, shares of held percentages and of thin touches."""
    share = lambda c: (F.avg(F.when(F.col(c), 100.0).otherwise(0.0)))
    clamps = F.sum(F.col("clamp_raw") + F.col("clamp_min") + F.col("clamp_max") + F.col("clamp_zero"))
    v = F.col("conservative_bps")
    return sessions.groupBy("profile").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("trades").alias("trades"), share("terminal_open").alias("open_pct"), share("carried_out").alias("carried_pct"), share("right_censored").alias("censored_pct"),
        F.median(v).alias("median_bps"), F.avg(v).alias("mean_bps"), F.min(v).alias("worst_bps"), F.avg(F.when(v > 0, 100.0).otherwise(0.0)).alias("gain_pct"), F.max("drawdown_bps").alias("drawdown_bps"), F.sum("turnover").alias("turnover"),
        (F.try_divide(F.sum(F.col("clamp_min") + F.col("clamp_max")), clamps) * 100).alias("held_pct"), (F.try_divide(F.sum("thin_touches"), F.sum("touches")) * 100).alias("thin_pct"),
    )


def chain_economics(sessions: DataFrame) -> DataFrame:
    """Per setting and chain: sessions, compounded return, the largest fall of the compounded equity between sessions, nights
    carried, and the share of sessions that end below the highest equity so far."""
    w = Window.partitionBy("profile", "con_id", "chain").orderBy("session_id")
    e = sessions.withColumn("_e", F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 + F.col("conservative_bps") / 1e4))).over(w)))
    e = e.withColumn("_top", F.greatest(F.lit(1.0), F.max("_e").over(w)))
    return e.groupBy("profile", "con_id", "chain").agg(
        F.count(F.lit(1)).alias("sessions"), ((F.max_by("_e", "session_id") - 1) * 1e4).alias("return_bps"), (F.max(1 - F.col("_e") / F.col("_top")) * 1e4).alias("drawdown_bps"), F.count_if("carried_out").alias("nights"),
        F.avg(F.when(F.col("_e") < F.col("_top") - 1e-12, 100.0).otherwise(0.0)).alias("underwater_pct"),
    )
