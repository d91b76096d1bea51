"""More relational operators over recordings and cycles: derived sessions, pairings, set operations, top-k, carrying forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, grids, orders, quality, quotes
from ..util import table
from .market_queries import C, S, T, X, cycles_once


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return quotes.with_prices(quotes.clean_ticks(table(spark, d, "ticks")))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instruments").groupBy("con_id").agg(F.min("time_zone_id").alias("zone"), F.min("symbol").alias("symbol"))


def derived_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as the readings alone show them: per contract and date at its exchange."""
    t = table(spark, d, "ticks").select("con_id", "tick_id", "captured_at_utc").join(_zones(spark, d), "con_id")
    day = F.to_date(F.from_utc_timestamp("captured_at_utc", F.col("zone"))).alias("local_day")
    return t.groupBy("con_id", day).agg(F.min(F.unix_micros("captured_at_utc")).alias("start_us"), F.max(F.unix_micros("captured_at_utc")).alias("end_us"), F.count_distinct("tick_id").alias("readings"))


def fill_session_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each fill's session date: that of the only session whose schedule holds it, else the date at the exchange."""
    f = orders.fills_once(table(spark, d, "executions")).select("id", "e", "t")
    s = quality.sessions_once(table(spark, d, "sessions")).select(F.upper("symbol").alias("e"), "session_date", F.col("open_us").alias("lo"), F.col("close_us").alias("hi"))
    hit = asof.interval_join(f, s, ["e"]).groupBy("id").agg(F.count_distinct("session_date").alias("n"), F.min("session_date").alias("sd"))
    zone = _zones(spark, d).groupBy(F.upper("symbol").alias("e")).agg(F.min("zone").alias("zone"))
    local = F.to_date(F.from_utc_timestamp(F.timestamp_micros("t"), F.coalesce("zone", F.lit("UTC"))))
    j = f.join(hit, "id", "left").join(zone, "e", "left")
    return j.select("id", F.coalesce(F.when(F.col("n") == 1, scalars.session_day(F.col("sd"))), local).alias("session_day"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("scheduled"))


def setting_medians(spark: SparkSession, d: str) -> DataFrame:
    """Field-wise medians and majorities of each bot's settings."""
    c = table(spark, d, "cycles").where("id is not null").groupBy("id").agg(F.min("bot_id").alias("bot_id"), F.max("initial_drop_pct").alias("drop_pct"), F.max("rise_trigger_pct").alias("rise"), F.max("atr_period").alias("period"), F.bool_or("atr_adaptive_enabled").alias("adaptive"))
    return c.groupBy("bot_id").agg(F.median("drop_pct").alias("drop_pct"), F.median("rise").alias("rise"), F.median("period").alias("period"), (F.count_if("adaptive") * 2 >= F.count("adaptive")).alias("adaptive"))


def top_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The three best cycles of every bot (ties: the smaller id)."""
    c = cycles_once(table(spark, d, "cycles")).where("net_pnl is not null").select("bot_id", "id", "net_pnl")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("bot_id").orderBy(F.desc("net_pnl"), "id"))).where("rank <= 3")


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return cycles_once(table(spark, d, "cycles")).groupBy("stage").agg(F.count(F.lit(1)).alias("cycles"), F.count_distinct("ticker").alias("tickers"))


def symbols_not_traded(spark: SparkSession, d: str) -> DataFrame:
    """Listed symbols without a fill (set difference)."""
    return table(spark, d, "instruments").select(F.upper("symbol").alias("symbol")).exceptAll(table(spark, d, "executions").select(F.upper(F.trim("ticker")).alias("symbol")).distinct()).distinct()


def paired_bots(spark: SparkSession, d: str) -> DataFrame:
    """Every bot against the first one on the (ticker, day) pairs both have: pairs, mean and median difference of results."""
    c = cycles_once(table(spark, d, "cycles")).where("net_pnl is not null").groupBy("bot_id", "ticker", F.to_date("created_at").alias("day")).agg(F.avg("net_pnl").alias("v"))
    control = c.agg(F.min("bot_id").alias("control"))
    base = c.join(F.broadcast(control), F.col("bot_id") == F.col("control")).select("ticker", "day", F.col("v").alias("b"))
    j = c.join(F.broadcast(control), F.col("bot_id") != F.col("control")).join(base, ["ticker", "day"])
    return j.groupBy("bot_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("v") - F.col("b")).alias("mean_delta"), F.median(F.col("v") - F.col("b")).alias("median_delta"))


def session_differences(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose readings and stored tick_count differ, or that stand on one side only (full outer join)."""
    s = table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("tick_count").alias("stored"))
    t = table(spark, d, "ticks").groupBy("session_id").agg(F.count_distinct("tick_id").alias("found"))
    return s.join(t, "session_id", "full").where("not (stored <=> found)").select("session_id", "stored", "found")


def gap_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a session's readings without a pause over 60 s of the monotonic clock."""
    w = Window.partitionBy("session_id").orderBy("elapsed_ns", "sequence", "tick_id")
    t = quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", "sequence", "elapsed_ns"])
    t = t.withColumn("_new", F.when(F.col("elapsed_ns") - F.lag("elapsed_ns").over(w) <= 60_000_000_000, 0).otherwise(1)).withColumn("segment", F.sum("_new").over(w))
    return t.groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("readings"), F.min("elapsed_ns").alias("first_ns"), F.max("elapsed_ns").alias("last_ns"))


def combined_recordings(spark: SparkSession, d: str) -> DataFrame:
    """One recording per contract: readings renumbered over its sessions, the clock rebased on the first reading and strictly rising."""
    t = quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", "con_id", "captured_at_utc"]).withColumn("us", F.unix_micros("captured_at_utc"))
    o, same = Window.partitionBy("con_id").orderBy("us", "tick_id"), Window.partitionBy("con_id", "us").orderBy("tick_id")
    base = t.groupBy("con_id").agg(F.min("us").alias("_base"))
    t = t.withColumns({"sequence": F.row_number().over(o).cast("long"), "_i": F.row_number().over(same) - 1}).join(base, "con_id")
    return t.select("con_id", "tick_id", "sequence", ((F.col("us") - F.col("_base")) * 1000 + F.col("_i")).alias("elapsed_ns"))


def spread_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Spread in basis points per symbol."""
    t = _ticks(spark, d).withColumn("bps", scalars.spread_bps(F.col("vbid"), F.col("vask"))).where("bps is not null")
    return orders.cost_percentiles(t, ["symbol"], F.col("bps"))


def last_known(spark: SparkSession, d: str) -> DataFrame:
    """The last carried forward where a reading has none."""
    w = Window.partitionBy("session_id").orderBy("elapsed_ns", "sequence", "tick_id")
    t = quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", "sequence", "elapsed_ns", "last"])
    return t.withColumn("carried", F.last("last", True).over(w)).where("last is null and carried is not null").select("tick_id", "carried")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    step = lambda n: (F.round(F.col(n) * 4) / 4).alias(n)
    return cycles_once(table(spark, d, "cycles")).select(step("initial_drop_pct"), step("rise_trigger_pct"), step("sell_trailing_stop_pct")).dropna().distinct()


def grid_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Grid points and how many others differ from them in the drop alone, by at most 0.5: an equi-join with a range."""
    g = _grid(spark, d)
    o = g.withColumnRenamed("initial_drop_pct", "_drop")
    j = g.join(o, ["rise_trigger_pct", "sell_trailing_stop_pct"]).where("abs(initial_drop_pct - _drop) <= 0.5 and initial_drop_pct <> _drop")
    return j.groupBy("initial_drop_pct", "rise_trigger_pct", "sell_trailing_stop_pct").agg(F.count(F.lit(1)).alias("neighbours"))


def grid_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours every grid point has along each axis, a quarter away at most."""
    axes = ["initial_drop_pct", "rise_trigger_pct", "sell_trailing_stop_pct"]
    return grids.adjacent(_grid(spark, d), axes, 0.25).groupBy("axis", *axes).agg(F.count(F.lit(1)).alias("neighbours"))


def collapsed_settings(spark: SparkSession, d: str) -> DataFrame:
    """Cycles whose held percentages agree share one leader, which alone needs a replay."""
    c = cycles_once(table(spark, d, "cycles")).select("id", *[F.least(F.greatest(F.round(n, 1), F.lit(0.5)), F.lit(2.0)).alias(n) for n in ("initial_drop_pct", "rise_trigger_pct")])
    return grids.collapse(c, "id", ["initial_drop_pct", "rise_trigger_pct"])


QUERIES = {
    f.__name__: f
    for f in (derived_sessions, fill_session_dates, setting_medians, top_cycles, stage_counts, symbols_not_traded, paired_bots, session_differences, gap_segments, combined_recordings, spread_percentiles, last_known, grid_neighbours, grid_adjacency, collapsed_settings)
}

_C = C.replace("net_pnl := net_pnl,", "net_pnl := net_pnl, initial_drop_pct := initial_drop_pct,")
_I = "i as (select con_id, min(time_zone_id) as zone, min(symbol) as symbol from instruments group by 1)"
SQL = {
    "derived_sessions": f"with {_I} select con_id, cast(timezone(zone, captured_at_utc) as date) as local_day, min(epoch_us(captured_at_utc)) as start_us, max(epoch_us(captured_at_utc)) as end_us, count(distinct tick_id) as readings from ticks join i using (con_id) group by 1, 2",
    "fill_session_dates": f"""with {X}, {_I}, {S}, h as (select x.id, count(distinct s.session_date) as n, min(s.session_date) as sd from x join (select s.*, upper(sy.symbol) as e from s join (select session_id, min(symbol) as symbol from sessions group by 1) sy using (session_id)) s on s.e = x.e and x.t >= s.open_us and x.t < s.close_us group by 1),
z as (select upper(symbol) as e, min(zone) as zone from i group by 1)
select x.id, coalesce(case when n = 1 then cast(coalesce(try_strptime(sd, '%Y%m%d'), try_strptime(sd, '%Y-%m-%d')) as date) end, cast(timezone(coalesce(zone, 'UTC'), make_timestamptz(x.t)) as date)) as session_day, coalesce(n = 1, false) as scheduled from x left join h using (id) left join z on z.e = x.e""",
    "setting_medians": """with c as (select id, min(bot_id) as bot_id, max(initial_drop_pct) as dr, max(rise_trigger_pct) as rise, max(atr_period) as period, bool_or(atr_adaptive_enabled) as adaptive from cycles where id is not null group by 1)
select bot_id, median(dr) as drop_pct, median(rise) as rise, median(period) as period, count(*) filter (adaptive) * 2 >= count(adaptive) as adaptive from c group by 1""",
    "top_cycles": f"with {C}, r as (select bot_id, id, net_pnl, row_number() over (partition by bot_id order by net_pnl desc, id) as rank from c where net_pnl is not null) select * from r where rank <= 3",
    "stage_counts": f"with {C} select stage, count(*) as cycles, count(distinct ticker) as tickers from c group by 1",
    "symbols_not_traded": "select upper(symbol) as symbol from instruments except select upper(trim(ticker)) from executions",
    "paired_bots": f"""with {C}, y as (select bot_id, ticker, cast(created_at as date) as day, avg(net_pnl) as v from c where net_pnl is not null group by 1, 2, 3), m as (select min(bot_id) as k from y)
select a.bot_id, count(*) as pairs, avg(a.v - b.v) as mean_delta, median(a.v - b.v) as median_delta from y a join y b using (ticker, day), m where a.bot_id <> k and b.bot_id = k group by 1""",
    "session_differences": """with s as (select session_id, max(tick_count) as stored from sessions where session_id is not null group by 1), t as (select session_id, count(distinct tick_id) as found from ticks group by 1)
select coalesce(s.session_id, t.session_id) as session_id, stored, found from s full join t on s.session_id = t.session_id where stored is distinct from found""",
    "gap_segments": f"""with {T}, l as (select *, case when elapsed_ns - lag(elapsed_ns) over w <= 60000000000 then 0 else 1 end as nw from t window w as (partition by session_id order by elapsed_ns, sequence, tick_id)),
g as (select *, (sum(nw) over (partition by session_id order by elapsed_ns, sequence, tick_id))::bigint as segment from l) select session_id, segment, count(*) as readings, min(elapsed_ns) as first_ns, max(elapsed_ns) as last_ns from g group by 1, 2""",
    "combined_recordings": f"with {T} select con_id, tick_id, row_number() over (partition by con_id order by us, tick_id) as sequence, (us - min(us) over (partition by con_id)) * 1000 + row_number() over (partition by con_id, us order by tick_id) - 1 as elapsed_ns from t",
    "spread_percentiles": f"with {T}, b as (select symbol, (vask - vbid) / ((vask + vbid) / 2) * 10000 as v from t where vbid > 0 and vask >= vbid) select symbol, count(v) as n, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90 from b group by 1",
    "last_known": f"with {T}, y as (select tick_id, last, last_value(last ignore nulls) over (partition by session_id order by elapsed_ns, sequence, tick_id) as carried from t) select tick_id, carried from y where last is null and carried is not null",
    "grid_adjacency": f"""with {_C}, g as (select distinct round(initial_drop_pct * 4) / 4 as initial_drop_pct, round(rise_trigger_pct * 4) / 4 as rise_trigger_pct, round(sell_trailing_stop_pct * 4) / 4 as sell_trailing_stop_pct from c where initial_drop_pct is not null and rise_trigger_pct is not null and sell_trailing_stop_pct is not null),
p as (select a.*, b.initial_drop_pct as x, b.rise_trigger_pct as y, b.sell_trailing_stop_pct as z from g a join g b on (a.initial_drop_pct = b.initial_drop_pct)::int + (a.rise_trigger_pct = b.rise_trigger_pct)::int + (a.sell_trailing_stop_pct = b.sell_trailing_stop_pct)::int = 2
  and abs(a.initial_drop_pct - b.initial_drop_pct) + abs(a.rise_trigger_pct - b.rise_trigger_pct) + abs(a.sell_trailing_stop_pct - b.sell_trailing_stop_pct) <= 0.25 + 1e-9)
select case when initial_drop_pct <> x then 'initial_drop_pct' when rise_trigger_pct <> y then 'rise_trigger_pct' else 'sell_trailing_stop_pct' end as axis, initial_drop_pct, rise_trigger_pct, sell_trailing_stop_pct, count(*) as neighbours from p group by 1, 2, 3, 4""",
    "grid_neighbours": f"""with {_C}, g as (select distinct round(initial_drop_pct * 4) / 4 as initial_drop_pct, round(rise_trigger_pct * 4) / 4 as rise_trigger_pct, round(sell_trailing_stop_pct * 4) / 4 as sell_trailing_stop_pct from c where initial_drop_pct is not null and rise_trigger_pct is not null and sell_trailing_stop_pct is not null)
select a.initial_drop_pct, rise_trigger_pct, sell_trailing_stop_pct, count(*) as neighbours from g a join g b using (rise_trigger_pct, sell_trailing_stop_pct) where abs(a.initial_drop_pct - b.initial_drop_pct) <= 0.5 and a.initial_drop_pct <> b.initial_drop_pct group by 1, 2, 3""",
    "collapsed_settings": f"""with {_C}, s as (select id, least(greatest(round(initial_drop_pct, 1), 0.5), 2.0) as a, least(greatest(round(rise_trigger_pct, 1), 0.5), 2.0) as b from c), l as (select a, b, min(id) as leader from s group by 1, 2)
select s.id, l.leader from s join l on s.a is not distinct from l.a and s.b is not distinct from l.b""",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "setting_medians": ["drop_pct", "rise", "period"],
    "top_cycles": ["net_pnl"],
    "paired_bots": ["mean_delta", "median_delta"],
    "spread_percentiles": ["p50", "p75", "p90"],
    "last_known": ["carried"],
    "grid_neighbours": ["initial_drop_pct", "rise_trigger_pct", "sell_trailing_stop_pct"],
}
