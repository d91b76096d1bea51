"""Queries over the recordings: prices, bars, ATR, order checks, quality, as-of and range joins, first triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, bars, orders, quality, quotes, rejects, triggers
from ..util import table

BAR_S, PERIOD = 60, 14
HALF_HOUR_US = 1_800_000_000


def _ticks(spark: SparkSession, d: str, clustered: bool = False) -> DataFrame:
    return quotes.with_prices(quotes.clean_ticks(table(spark, d, "ticks"), clustered=clustered))


def _prices_as_delivered(spark: SparkSession, d: str) -> DataFrame:
    """Prices of all deliveries, for aggregates that a repeated reading does not change: no shuffle."""
    return quotes.with_prices(table(spark, d, "ticks").where("tick_id is not null").select(*quotes.READING))


def quote_prices(spark: SparkSession, d: str) -> DataFrame:
    return _ticks(spark, d).select("tick_id", "vbid", "vask", "price", "full_snapshot", "last_event", "bid_event", "ask_event")


def live_readings(spark: SparkSession, d: str) -> DataFrame:
    return quotes.live_rows(quotes.clean_ticks(table(spark, d, "ticks"))).select("session_id", "tick_id", "market_data_type")


def feed_evidence(spark: SparkSession, d: str) -> DataFrame:
    return quotes.feed_evidence(quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", "market_data_type"]))


def order_checks(spark: SparkSession, d: str) -> DataFrame:
    return quotes.order_checks(table(spark, d, "ticks"))


def compressed_readings(spark: SparkSession, d: str) -> DataFrame:
    return quotes.compress(_ticks(spark, d)).select("session_id", "tick_id")


def changed_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ticks").groupBy("changed_fields").agg(F.count(F.lit(1)).alias("readings"))
    c = scalars.changed_list(F.col("changed_fields"))
    x = x.withColumn("c", c)
    return x.select("changed_fields", "readings", F.array_join("c.fields", ",").alias("fields"), F.size("c.unknown").alias("unknown"), F.col("c.repeated").alias("repeated"))


def ohlc_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.ohlc(_ticks(spark, d), BAR_S)


def latest_atr(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: minute bars, their true range and 14-bar ATR%, and each session's latest, ranked."""
    return bars.latest(bars.bar_atr(bars.ohlc(_prices_as_delivered(spark, d), BAR_S).drop("readings"), PERIOD))


def tick_atr(spark: SparkSession, d: str) -> DataFrame:
    return bars.tick_atr(_ticks(spark, d, True), PERIOD, BAR_S)


def tick_atr_phase(spark: SparkSession, d: str) -> DataFrame:
    """Per session how far the mean ATR% moves over all 5-second phases of the bars; the phases run as one job."""
    t = _ticks(spark, d).where("price is not null").select("session_id", "tick_id", "captured_at_utc", "price", "elapsed_ns", "sequence")
    t = t.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(BAR_S - 5), F.lit(5))))
    t = t.withColumn("elapsed_ns", F.col("elapsed_ns") + F.col("phase").cast("long") * 1_000_000_000).withColumn("session_id", F.struct("session_id", "phase"))
    a = bars.tick_atr(t, PERIOD, BAR_S).where("atr_pct is not null").groupBy("session_id").agg(F.avg("atr_pct").alias("m"))
    return a.groupBy(F.col("session_id.session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("phases"), F.min("m").alias("lowest"), F.max("m").alias("highest"))


def session_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.session_quality(_ticks(spark, d), table(spark, d, "sessions"))


def continuity_chains(spark: SparkSession, d: str) -> DataFrame:
    return quality.continuity_chains(table(spark, d, "sessions"))


def scheduled_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings per session whose schedule (half-open) holds them, by contract and time alone."""
    s = quality.sessions_once(table(spark, d, "sessions")).select("session_id", "con_id", F.col("open_us").alias("lo"), F.col("close_us").alias("hi"))
    t = quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", "con_id", "captured_at_utc"]).select("con_id", F.unix_micros("captured_at_utc").alias("t"))
    return asof.interval_join(t, s, ["con_id"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("readings"))


def fill_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each fill with the latest sound quote of its side, at most 5 s old."""
    t = _ticks(spark, d)
    q = t.select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), F.col("tick_id").alias("o"), F.explode(F.array(F.struct(F.lit("BOT").alias("side"), F.col("vask").alias("quote")), F.struct(F.lit("SLD").alias("side"), F.col("vbid").alias("quote")))).alias("_")).select("e", "t", "o", "_.*").where("quote is not null")
    x = orders.fills_once(table(spark, d, "executions")).select("id", "e", "side", "t", "price")
    j = asof.asof_backward(x, q, ["e", "side"], ["quote"], 5_000_000)
    worse = F.when(F.col("side") == "BOT", F.col("price") / F.col("m.quote") - 1).otherwise(F.col("m.quote") / F.col("price") - 1)
    return j.where("m is not null").select("id", "side", F.col("m.quote").alias("quote"), ((F.col("t") - F.col("m.t")) / 1e6).alias("age_s"), (F.greatest(worse, F.lit(0.0)) * 10000).alias("slippage_bps"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Captured points, repeated readings once (their last line)."""
    return rejects.capture_points(table(spark, d, "capture_lines")).groupBy("cycle_id", "captured_at_utc", "price", "atr_pct").agg(F.max("line_id").alias("line_id"))


def fill_context(spark: SparkSession, d: str) -> DataFrame:
    """Each fill with the latest captured point of its cycle, at most 60 s old; of one instant the last line counts."""
    p = _points(spark, d).select("cycle_id", F.unix_micros("captured_at_utc").alias("t"), F.col("line_id").alias("o"), F.col("price").alias("point"))
    x = orders.fills_once(table(spark, d, "executions")).select("id", "cycle_id", "t")
    return asof.asof_backward(x, p, ["cycle_id"], ["point"], 60_000_000).where("m is not null").select("id", F.col("m.o").alias("line_id"), F.col("m.point").alias("point_price"))


def captured_atr(spark: SparkSession, d: str) -> DataFrame:
    """Each fill with the latest saved ATR% of its cycle, at most 180 s old; of one instant their median."""
    p = _points(spark, d).where("atr_pct is not null").groupBy("cycle_id", F.unix_micros("captured_at_utc").alias("t")).agg(F.median("atr_pct").alias("saved"), F.max("line_id").alias("o"))
    x = orders.fills_once(table(spark, d, "executions")).select("id", "cycle_id", "t")
    return asof.asof_backward(x, p, ["cycle_id"], ["saved"], 180_000_000).where("m is not null").select("id", F.col("m.saved").alias("atr_pct"))


def after_exit(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and highest bid in the five minutes after each sale."""
    b = _ticks(spark, d).where("vbid is not null").select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), "vbid")
    x = orders.fills_once(table(spark, d, "executions")).where("side = 'SLD'").select("id", "e", "t", "price")
    j = asof.forward_range(x, b, ["e"], 300_000_000).groupBy("id").agg(F.max("price").alias("price"), F.min("vbid").alias("lo"), F.max("vbid").alias("hi"), F.count(F.lit(1)).alias("quotes"))
    return j.select("id", "quotes", (F.greatest(F.lit(0.0), 1 - F.col("lo") / F.col("price")) * 10000).alias("avoided_bps"), (F.greatest(F.lit(0.0), F.col("hi") / F.col("price") - 1) * 10000).alias("regret_bps"))


def cycles_once(cycles: DataFrame) -> DataFrame:
    """Each cycle once, its latest state."""
    c = cycles.where("id is not null")
    return c.groupBy("id").agg(F.max_by(F.struct(*[x for x in c.columns if x != "id"]), F.struct(F.coalesce("updated_at", "created_at"), F.coalesce("net_pnl", F.lit(0.0)))).alias("x")).select("id", "x.*")


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return _ticks(spark, d).where("price is not null").select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), "price", "tick_id")


def _buys(spark: SparkSession, d: str) -> DataFrame:
    c = cycles_once(table(spark, d, "cycles"))
    return c.select("id", F.upper("ticker").alias("e"), F.unix_micros("created_at").alias("t"), "buy_rebound_trail_pct").where("buy_rebound_trail_pct > 0")


def first_buys(spark: SparkSession, d: str) -> DataFrame:
    return triggers.first_buy(triggers.paths(_buys(spark, d), _prices(spark, d), HALF_HOUR_US), "buy_rebound_trail_pct")


def buy_excursions(spark: SparkSession, d: str) -> DataFrame:
    p = triggers.paths(_buys(spark, d), _prices(spark, d), HALF_HOUR_US)
    return triggers.excursions(p, triggers.first_buy(p, "buy_rebound_trail_pct"))


def first_sells(spark: SparkSession, d: str) -> DataFrame:
    """First trailing sale of each filled cycle, activated where the buy price has risen by rise_trigger_pct percent."""
    c = cycles_once(table(spark, d, "cycles"))
    s = c.select("id", F.upper("ticker").alias("e"), F.unix_micros("buy_filled_at").alias("t"), (F.col("avg_buy_price") * (1 + F.col("rise_trigger_pct") / 100)).alias("required"), "sell_trailing_stop_pct").where("t is not null and required > 0 and sell_trailing_stop_pct > 0")
    return triggers.first_sell(triggers.paths(s, _prices(spark, d), 4 * HALF_HOUR_US), "required", "sell_trailing_stop_pct")


def quote_ages(spark: SparkSession, d: str) -> DataFrame:
    """Per session the mean and largest age of the bid; a bid event without a sound bid resets it to none."""
    w = Window.partitionBy("session_id").orderBy("elapsed_ns", "sequence", "tick_id")
    at = F.last(F.when(F.col("bid_event"), F.struct(F.when(F.col("vbid").isNotNull(), F.col("elapsed_ns")).alias("ns"))), True).over(w)
    a = _ticks(spark, d, True).withColumn("age", (F.col("elapsed_ns") - at["ns"]) / 1e9)
    return a.groupBy("session_id").agg(F.avg("age").alias("mean_age_s"), F.max("age").alias("max_age_s"), F.count("age").alias("aged"))


QUERIES = {
    f.__name__: f
    for f in (quote_prices, live_readings, feed_evidence, order_checks, compressed_readings, changed_lists, ohlc_bars, latest_atr, tick_atr, tick_atr_phase, session_quality, continuity_chains, scheduled_readings,
              fill_quotes, fill_context, captured_atr, after_exit, first_buys, buy_excursions, first_sells, quote_ages)
}

T = """t0 as (select distinct on (session_id, tick_id) session_id, tick_id, sequence, captured_at_utc, epoch_us(captured_at_utc) as us, elapsed_ns, symbol, con_id, bid, ask, last, close, mark_price, market_data_type, changed_fields from ticks where tick_id is not null),
t1 as (select *, case when bid > 0 and isfinite(bid) then bid end as b, case when ask > 0 and isfinite(ask) then ask end as a, case when last > 0 and isfinite(last) then last end as l, replace(coalesce(changed_fields, ''), ' ', '') as ch from t0),
t2 as (select *, case when a < b then null else b end as vbid, case when a < b then null else a end as vask from t1),
t as (select *, case when vbid is not null and vask is not null then case when l between vbid and vask then l else (vbid + vask) / 2 end
  else coalesce(case when mark_price > 0 and isfinite(mark_price) then mark_price end, l, case when close > 0 and isfinite(close) then close end) end as price,
  ch = '' as full_snapshot, ch = '' or contains(',' || ch || ',', ',last,') as last_event, ch = '' or contains(',' || ch || ',', ',bid,') as bid_event, ch = '' or contains(',' || ch || ',', ',ask,') as ask_event from t2)"""
STAMP = "epoch_us(cast(case when regexp_matches(executed_at, '(Z|[+-]\\d\\d:?\\d\\d)$') then executed_at else executed_at || 'Z' end as timestamptz))"
X = f"""x as (select id, f.*, cast(make_timestamp(f.t) as date) as day, f.shares * f.price as notional from (
  select id, max_by(struct_pack(cycle_id := cycle_id, e := upper(trim(ticker)), order_ref := order_ref, side := side, shares := shares, price := price, commission := commission, t := {STAMP}),
    struct_pack(c := coalesce(commission, -1e300::double), t := coalesce({STAMP}, 0), x := coalesce(executed_at, ''), k := coalesce(ticker, ''), r := coalesce(order_ref, ''), y := coalesce(cycle_id, ''))) as f from executions where id is not null group by id))"""
S = """s as (select session_id, f.* from (select session_id, max_by(struct_pack(con_id := con_id, session_date := session_date, open_us := epoch_us(schedule_open_utc), close_us := epoch_us(schedule_close_utc), start_us := epoch_us(observed_start_utc), end_us := epoch_us(observed_end_utc)),
    struct_pack(a := coalesce(epoch_us(observed_end_utc), -1), b := coalesce(epoch_us(schedule_open_utc), -1), c := coalesce(epoch_us(observed_start_utc), -1), d := coalesce(epoch_us(schedule_close_utc), -1), e := coalesce(con_id, -1), g := coalesce(session_date, ''))) as f
  from sessions where session_id is not null group by session_id))"""
C = """c as (select id, x.* from (select id, max_by(struct_pack(bot_id := bot_id, ticker := ticker, stage := stage, created_at := created_at, updated_at := updated_at, buy_rebound_trail_pct := buy_rebound_trail_pct, rise_trigger_pct := rise_trigger_pct, sell_trailing_stop_pct := sell_trailing_stop_pct,
  buy_filled_at := buy_filled_at, avg_buy_price := avg_buy_price, buy_filled_qty := buy_filled_qty, sell_filled_qty := sell_filled_qty, avg_sell_price := avg_sell_price, sell_filled_at := sell_filled_at, protective_sell_filled_qty := protective_sell_filled_qty, net_pnl := net_pnl, atr_period := atr_period, atr_bar_seconds := atr_bar_seconds, cycle_number := cycle_number),
  struct_pack(u := coalesce(updated_at, created_at), n := coalesce(net_pnl, 0.0))) as x from cycles where id is not null group by id))"""
_BARS = f"bars as (select session_id, us // {BAR_S * 1_000_000} * {BAR_S} as bar, min_by(price, struct_pack(a := us, b := tick_id)) as open, max(price) as high, min(price) as low, max_by(price, struct_pack(a := us, b := tick_id)) as close, count(*) as readings from t where price is not null group by 1, 2)"
_BUY = f"""{C}, p as (select c.id, buy_rebound_trail_pct as trail, t.us as t, t.price, t.tick_id from c join t on t.symbol = upper(c.ticker) and t.us > epoch_us(c.created_at) and t.us <= epoch_us(c.created_at) + {HALF_HOUR_US} where t.price is not null and buy_rebound_trail_pct > 0),
r as (select *, min(price) over (partition by id order by t, tick_id) as low from p),
h as (select id, min(struct_pack(t := t, tick_id := tick_id, price := price, low := low)) filter (price >= low * (1 + trail / 100) and price > low) as x from r group by id)"""
_TICK_ATR = f"""p as (select session_id, tick_id, sequence, elapsed_ns, price, elapsed_ns // {BAR_S * 10**9} as bucket from t where price is not null),
r as (select *, max(price) over w as h, min(price) over w as l from p window w as (partition by session_id, bucket order by elapsed_ns, sequence, tick_id)),
f as (select session_id, bucket, max(price) as high, min(price) as low, max_by(price, struct_pack(a := elapsed_ns, b := sequence, c := tick_id)) as close, max(elapsed_ns) as end_ns from p group by 1, 2),
g as (select *, lag(close) over o as pc, row_number() over o as k, lag(end_ns, {PERIOD}) over o as oldest from f window o as (partition by session_id order by bucket)),
g2 as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from g),
g3 as (select *, coalesce(sum(tr) over (partition by session_id order by bucket rows between {PERIOD - 1} preceding and 1 preceding), 0) as earlier from g2)
select r.session_id, r.tick_id, case when k >= {PERIOD + 1} and oldest >= elapsed_ns - {max((PERIOD + 4) * BAR_S, 300)} * 1000000000::bigint and (earlier + greatest(h - l, abs(h - pc), abs(l - pc))) > 0 then (earlier + greatest(h - l, abs(h - pc), abs(l - pc))) / {PERIOD} / price * 100 end as atr_pct
from r join g3 using (session_id, bucket)"""

SQL = {
    "quote_prices": f"with {T} select tick_id, vbid, vask, price, full_snapshot, last_event, bid_event, ask_event from t",
    "live_readings": f"with {T}, y as (select *, max(case when market_data_type = 1 then 1 else 0 end) over (partition by session_id) as lv from t) select session_id, tick_id, market_data_type from y where market_data_type = case when lv = 1 then 1 else 3 end",
    "feed_evidence": f"""with {T}, n as (select session_id, count(*) filter (market_data_type = 1) as live, count(*) filter (market_data_type = 2) as frozen, count(*) filter (market_data_type = 3) as delayed, count(*) filter (market_data_type = 4) as delayed_frozen from t group by 1)
select *, live > 0 as any_live, (live > 0)::int + (frozen > 0)::int + (delayed > 0)::int + (delayed_frozen > 0)::int > 1 as mixed, frozen + delayed_frozen > 0 as any_frozen from n""",
    "order_checks": f"""with {T}, y as (select *, lag(sequence) over w as s, lag(us) over w as u, lag(elapsed_ns) over w as e from t window w as (partition by session_id order by sequence, tick_id))
select session_id, count(*) as readings, count(*) filter (sequence <> s + 1) as sequence_breaks, count(*) filter (us < u) as wall_reversals, count(*) filter (elapsed_ns < e) as clock_reversals from y group by 1""",
    "compressed_readings": f"""with {T}, y as (select *, row_number() over w as n, lead(1) over w as more, lag(struct_pack(a := coalesce(vbid, -1), b := coalesce(vask, -1), c := coalesce(price, -1), d := market_data_type)) over w as sig,
  case when price is not null then us // 1000000 end as sec from t window w as (partition by session_id order by elapsed_ns, sequence, tick_id)),
z as (select *, last_value(sec ignore nulls) over (partition by session_id order by elapsed_ns, sequence, tick_id rows between unbounded preceding and 1 preceding) as ps from y)
select session_id, tick_id from z where n = 1 or more is null or full_snapshot or last_event or sig is distinct from struct_pack(a := coalesce(vbid, -1), b := coalesce(vask, -1), c := coalesce(price, -1), d := market_data_type) or (sec is not null and sec is distinct from ps)""",
    "changed_lists": """with g as (select changed_fields, count(*) as readings from ticks group by 1), h as (select *, list_filter(list_transform(string_split(lower(coalesce(changed_fields, '')), ','), lambda x: trim(x)), lambda x: x <> '') as r,
  ['bid', 'bid_size', 'ask', 'ask_size', 'last', 'last_size', 'open', 'high', 'low', 'close', 'volume', 'mark_price'] as known from g)
select changed_fields, readings, coalesce(array_to_string(list_filter(known, lambda x: list_contains(r, x)), ','), '') as fields, len(list_distinct(list_filter(r, lambda x: not list_contains(known, x)))) as unknown, len(r) > len(list_distinct(r)) as repeated from h""",
    "ohlc_bars": f"with {T}, {_BARS} select * from bars",
    "latest_atr": f"""with {T}, {_BARS}, q as (select *, lag(close) over (partition by session_id order by bar) as pc from bars),
q2 as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from q),
q3 as (select *, case when count(tr) over w = {PERIOD} then avg(tr) over w end as atr from q2 window w as (partition by session_id order by bar rows between {PERIOD - 1} preceding and current row)),
m as (select session_id, max_by(struct_pack(bar := bar, close := close, atr := atr, atr_pct := atr / close * 100), bar) as x from q3 where atr > 0 group by 1),
n as (select session_id, x.* from m) select *, row_number() over (order by round(atr_pct, 9) desc, session_id) as rank from n""",
    "tick_atr": f"with {T}, {_TICK_ATR}",
    "session_quality": f"""with {T}, {S}, h as (select *, coalesce(last_event and last > 0 and isfinite(last), false) as hit from t),
y as (select *, (elapsed_ns - lag(elapsed_ns) over w) / 1e9 as gap, case when hit then (elapsed_ns - last_value(case when hit then elapsed_ns end ignore nulls) over (partition by session_id order by elapsed_ns, sequence, tick_id rows between unbounded preceding and 1 preceding)) / 1e9 end as lgap
  from h window w as (partition by session_id order by elapsed_ns, sequence, tick_id)),
n as (select session_id, count(distinct (us - open_us) // 60000000) as minutes from h join s using (session_id) where hit and us >= open_us and us < close_us group by 1),
a as (select session_id, count(*) as readings, max(gap) as max_gap_s, count(*) filter (hit) as last_events, quantile_cont(lgap, 0.95) as p95_last_gap_s, max(us) as last_us from y group by 1),
j as (select s.*, a.* exclude (session_id), minutes, greatest(coalesce(end_us, last_us), start_us) as e from s left join a using (session_id) left join n using (session_id) where close_us > open_us)
select session_id, coalesce(readings, 0) as readings, least(100, greatest(0, least(e, close_us) - greatest(start_us, open_us)) / 1e6 / ((close_us - open_us) / 1e6) * 100) as coverage_pct, greatest(0, (start_us - open_us) / 1e6) as start_lag_s, greatest(0, (close_us - e) / 1e6) as end_lead_s, max_gap_s,
  coalesce(last_events, 0) as last_events, least(100, coalesce(minutes, 0) / greatest(1, ceil((close_us - open_us) / 1e6 / 60)) * 100) as minute_coverage_pct, p95_last_gap_s from j""",
    "continuity_chains": f"""with {S}, d as (select *, coalesce(try_strptime(session_date, '%Y%m%d'), try_strptime(session_date, '%Y-%m-%d'))::date as day from s),
l as (select *, lag(day) over w as pd, lag(close_us) over w as pc from d window w as (partition by con_id order by open_us, session_id))
select session_id, con_id, (sum(case when day = pd + (case dayofweek(pd) when 5 then 3 when 6 then 2 else 1 end)::int and open_us >= pc then 0 else 1 end) over (partition by con_id order by open_us, session_id))::int as chain from l""",
    "scheduled_readings": f"with {T}, {S} select s.session_id, count(*) as readings from t join s on t.con_id = s.con_id and t.us >= s.open_us and t.us < s.close_us group by 1",
    "fill_quotes": f"""with {T}, {X}, q as (select symbol as e, us as t, tick_id, 'BOT' as side, vask as quote from t where vask is not null union all select symbol, us, tick_id, 'SLD', vbid from t where vbid is not null),
k as (select e, side, t, max_by(quote, tick_id) as quote from q group by 1, 2, 3),
j as (select x.id, x.side, x.price, x.t, k.quote, k.t as qt from x asof join k on x.e = k.e and x.side = k.side and x.t >= k.t)
select id, side, quote, (t - qt) / 1e6 as age_s, greatest(case side when 'BOT' then price / quote - 1 else quote / price - 1 end, 0) * 10000 as slippage_bps from j where t - qt <= 5000000""",
    "after_exit": f"""with {T}, {X}, j as (select x.id, max(x.price) as price, min(vbid) as lo, max(vbid) as hi, count(*) as quotes from x join t on t.symbol = x.e and t.us > x.t and t.us <= x.t + 300000000 where x.side = 'SLD' and vbid is not null group by 1)
select id, quotes, greatest(0, 1 - lo / price) * 10000 as avoided_bps, greatest(0, hi / price - 1) * 10000 as regret_bps from j""",
    "first_buys": f"with {T}, {_BUY} select id, x is not null as triggered, x.t as trigger_t, x.price as trigger_price, x.low as low from h",
    "buy_excursions": f"with {T}, {_BUY} select p.id, greatest(max((p.price / h.x.price - 1) * 10000), 0) as mfe_bps, greatest(-min((p.price / h.x.price - 1) * 10000), 0) as mae_bps from p join h on p.id = h.id and h.x is not null and p.t >= h.x.t group by 1",
    "first_sells": f"""with {T}, {C}, z as (select id, upper(ticker) as e, epoch_us(buy_filled_at) as t0, avg_buy_price * (1 + rise_trigger_pct / 100) as required, sell_trailing_stop_pct as trail from c where buy_filled_at is not null and avg_buy_price * (1 + rise_trigger_pct / 100) > 0 and sell_trailing_stop_pct > 0),
p as (select z.*, t.us as t, t.price, t.tick_id from z join t on t.symbol = z.e and t.us > z.t0 and t.us <= z.t0 + {4 * HALF_HOUR_US} where t.price is not null),
o as (select *, max(case when price >= required then 1 else 0 end) over (partition by id order by t, tick_id) as act from p),
r as (select *, row_number() over w as n, max(price) over w as high from o where act = 1 window w as (partition by id order by t, tick_id)),
g as (select id, min(struct_pack(t := t, tick_id := tick_id)) as a, min(struct_pack(t := t, tick_id := tick_id, price := price, high := high)) filter (n > 1 and price <= high * (1 - trail / 100)) as x from r group by id)
select id, a.t as activation_t, x is not null as triggered, x.t as trigger_t, x.price as trigger_price, x.high as high from g""",
    "quote_ages": f"""with {T}, y as (select *, last_value(case when bid_event then struct_pack(ns := case when vbid is not null then elapsed_ns end) end ignore nulls) over (partition by session_id order by elapsed_ns, sequence, tick_id) as ev from t)
select session_id, avg((elapsed_ns - ev.ns) / 1e9) as mean_age_s, max((elapsed_ns - ev.ns) / 1e9) as max_age_s, count((elapsed_ns - ev.ns)) as aged from y group by 1""",
}
from .data_queries import _P4  # noqa: E402

_PHASES = _TICK_ATR.replace("p as (select session_id, tick_id, sequence, elapsed_ns,", "p as (select {'s': session_id, 'p': phase} as session_id, tick_id, sequence, elapsed_ns,").replace("from t where", "from (select * replace (elapsed_ns + phase * 1000000000 as elapsed_ns) from t, range(0, 60, 5) as r(phase)) where")
SQL["tick_atr_phase"] = f"with {T}, ph as (with {_PHASES}), m as (select session_id, avg(atr_pct) as m from ph where atr_pct is not null group by 1) select session_id.s as session_id, count(*) as phases, min(m) as lowest, max(m) as highest from m group by 1"
_POINTS = f"""v0 as ({_P4}), v1 as (select v0.*, list_transform(regexp_extract_all(',' || line_text, ',((?:"[^"]*")+|[^",]*)', 1, 's'), lambda y: case when y[1] = '"' then replace(y[2:-2], '""', '"') else y end) as c from v0 join capture_lines using (line_id) where not bad and n = 11 and ts_ok and price_ok and ch_ok),
pt as (select line_id, c[4] as cycle_id, epoch_us(cast(case when regexp_matches(ts, '(Z|[+-]\\d\\d:\\d\\d)$') then ts else ts || 'Z' end as timestamptz)) as t, cast(case when left(price, 1) = '+' then price[2:] else price end as double) as price, try_cast(nullif(c[9], '') as double) as atr_pct from v1)"""
SQL["captured_atr"] = f"""with {_POINTS}, {X}, k as (select cycle_id, t, median(atr_pct) as saved from (select distinct cycle_id, t, price, atr_pct from pt) where atr_pct is not null group by 1, 2)
select x.id, k.saved as atr_pct from x asof join k on x.cycle_id = k.cycle_id and x.t >= k.t where x.t - k.t <= 180000000"""
SQL["fill_context"] = f"""with {_POINTS}, {X}, k as (select cycle_id, t, max(line_id) as line_id, max_by(price, line_id) as price from pt group by 1, 2)
select x.id, k.line_id, k.price as point_price from x asof join k on x.cycle_id = k.cycle_id and x.t >= k.t where x.t - k.t <= 60000000"""

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "quote_prices": ["vbid", "vask", "price"],
    "ohlc_bars": ["open", "high", "low", "close"],
    "latest_atr": ["close", "atr", "atr_pct"],
    "tick_atr": ["atr_pct"],
    "session_quality": ["coverage_pct", "start_lag_s", "end_lead_s", "max_gap_s", "minute_coverage_pct", "p95_last_gap_s"],
    "fill_quotes": ["quote", "age_s", "slippage_bps"],
    "after_exit": ["avoided_bps", "regret_bps"],
    "first_buys": ["trigger_price", "low"],
    "buy_excursions": ["mfe_bps", "mae_bps"],
    "first_sells": ["trigger_price", "high"],
    "quote_ages": ["mean_age_s", "max_age_s"],
    "tick_atr_phase": ["lowest", "highest"],
    "captured_atr": ["atr_pct"],
    "fill_context": ["point_price"],
}
