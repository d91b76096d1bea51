"""Queries over fills, cycles and fragments: orders, costs, scores, resampling, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fragments, grids, orders, stats
from ..util import table
from .market_queries import C, X, cycles_once

SEED, REPLICATES = 20240101, 2000
#: Weights of the four score policies: policy, median, mean, worst, drawdown, open share.
POLICIES = [("balanced", 0.5, 0.3, 0.2, 0.35, 25.0), ("drawdown", 0.35, 0.15, 0.5, 0.7, 35.0), ("return", 0.55, 0.35, 0.1, 0.2, 20.0), ("stressed", 0.5, 0.3, 0.2, 0.5, 40.0)]


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return orders.fills_once(table(spark, d, "executions"))


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    return cycles_once(table(spark, d, "cycles"))


def fills_once(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d).select("id", "e", "side", "t", "notional", "commission")


def order_groups(spark: SparkSession, d: str) -> DataFrame:
    return orders.by_order(_fills(spark, d))


def allocated_commissions(spark: SparkSession, d: str) -> DataFrame:
    """Half of what a cycle lost to costs (gross less net) on each side, shared among its orders."""
    c = _cycles(spark, d).where("gross_pnl - net_pnl > 0").select(F.col("id").alias("cycle_id"), ((F.col("gross_pnl") - F.col("net_pnl")) / 2).alias("total"), F.explode(F.array(F.lit("BOT"), F.lit("SLD"))).alias("side"))
    return orders.allocate(orders.by_order(_fills(spark, d)), c).select("cycle_id", "side", "order_key", "allocated")


def commission_percentiles(spark: SparkSession, d: str) -> DataFrame:
    f = _fills(spark, d).where("commission > 0 and notional > 0")
    return orders.cost_percentiles(f, ["e", "side"], F.col("commission") / F.col("notional") * 10000)


def cross_fitted_costs(spark: SparkSession, d: str) -> DataFrame:
    f = _fills(spark, d).where("commission > 0 and notional > 0")
    days = f.groupBy(F.col("e").alias("key"), "day").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("commission") / F.col("notional") * 10000).alias("cost"))
    return orders.cross_fitted(days, 20, 1.0)


def cycle_fills(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle's bought quantity and price: the stored ones, else those of its fills."""
    v = _fills(spark, d).where("side = 'BOT'").groupBy("cycle_id").agg(F.sum("shares").alias("q"), F.try_divide(F.sum("notional"), F.sum("shares")).alias("vwap"), F.max("t").alias("t"))
    c = _cycles(spark, d).select("id", "buy_filled_qty", "avg_buy_price", F.unix_micros("buy_filled_at").alias("bt"))
    j = c.join(v, c["id"] == v["cycle_id"], "left")
    ok = (F.col("buy_filled_qty") > 0) & (F.col("avg_buy_price") > 0)
    return j.select("id", F.when(ok, F.col("buy_filled_qty")).otherwise(F.col("q")).alias("quantity"), F.when(ok, F.col("avg_buy_price")).otherwise(F.col("vwap")).alias("price"), F.coalesce("bt", "t").alias("filled_t"), F.col("q").isNull().alias("no_fills"))


def fills_without_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Fills whose cycle is missing from the cycles (anti join)."""
    return _fills(spark, d).select("id", "cycle_id").join(table(spark, d, "cycles").select(F.col("id").alias("cycle_id")), "cycle_id", "left_anti").select("id", "cycle_id")


def completed_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles whose stage says so, or whose sales cover what was bought."""
    sold = F.greatest(F.coalesce("sell_filled_qty", F.lit(0.0)), F.coalesce("protective_sell_filled_qty", F.lit(0.0)))
    full = (F.col("buy_filled_qty") > 0) & (sold >= F.col("buy_filled_qty") - F.greatest(F.lit(1e-8), F.col("buy_filled_qty") * 1e-9))
    return _cycles(spark, d).select("id", (F.col("stage").endswith("CYCLE_COMPLETE") | F.coalesce(full, F.lit(False))).alias("completed"))


def pnl_summary(spark: SparkSession, d: str) -> DataFrame:
    """Results by bot and ticker and by bot alone, in one pass over grouping sets."""
    c = _cycles(spark, d).select("bot_id", "ticker", "net_pnl", "stage")
    g = c.groupingSets([[F.col("bot_id")], [F.col("bot_id"), F.col("ticker")]], F.col("bot_id"), F.col("ticker"))
    return g.agg(F.count(F.lit(1)).alias("cycles"), F.count("net_pnl").alias("closed"), F.median("net_pnl").alias("median_pnl"), F.sum("net_pnl").alias("net_pnl"), F.grouping("ticker").cast("int").alias("all_tickers"))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    c = _cycles(spark, d).where("net_pnl is not null and buy_filled_qty > 0 and avg_buy_price > 0")
    return c.select("id", "bot_id", "ticker", F.to_date("created_at").alias("day"), (F.col("net_pnl") / (F.col("buy_filled_qty") * F.col("avg_buy_price")) * 10000).alias("value"), "created_at", "sell_filled_at")


def return_scores(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d).withColumns({"drawdown": F.greatest(-F.col("value"), F.lit(0.0)), "open": F.col("sell_filled_at").isNull()})
    p = spark.createDataFrame(POLICIES, "policy string, w_median double, w_mean double, w_worst double, w_drawdown double, w_open double")
    return stats.score(r, ["ticker"], p)


def return_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.day_bootstrap(_returns(spark, d), ["bot_id"], SEED, REPLICATES)


def return_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return stats.leave_one_day_out(_returns(spark, d), ["bot_id"])


def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Moving-block bootstrap of the daily mean return over all bots: 80 and 95 % intervals."""
    days = _returns(spark, d).groupBy("day").agg(F.avg("value").alias("m")).withColumn("unit", F.row_number().over(Window.orderBy("day")) - 1)
    n = days.count()
    length = stats.moving_block_length(n) or 1
    ix = stats.block_indices(spark, str(SEED), REPLICATES, max(n, 1), length)
    rep = ix.join(days, "unit").groupBy("rep").agg(F.avg("m").alias("m"))
    return rep.agg(F.count(F.lit(1)).alias("replicates"), *[F.percentile("m", F.lit(q)).alias(c) for q, c in ((0.025, "lo95"), (0.1, "lo80"), (0.9, "hi80"), (0.975, "hi95"))])


def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    """Mean return of training and validation days per expanding fold."""
    days = _returns(spark, d).groupBy("day").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c")).withColumn("unit", F.row_number().over(Window.orderBy("day")) - 1)
    n = days.count()
    folds = [(i, a.stop, b.stop) for i, (a, b) in enumerate(stats.walk_forward(n, max(2, n // 2), 1))]
    f = F.broadcast(spark.createDataFrame(folds, "fold int, train_end int, valid_end int"))
    j = days.join(f, days["unit"] < f["valid_end"])
    part = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("c"))))
    return j.groupBy("fold").agg(part(F.col("unit") < F.col("train_end")).alias("train"), part(F.col("unit") >= F.col("train_end")).alias("validate"))


def hold_survival(spark: SparkSession, d: str) -> DataFrame:
    """Kaplan-Meier curve of minutes from buy to sale per bot; open positions are censored at their last update."""
    c = _cycles(spark, d).where("buy_filled_at is not null")
    end = F.coalesce("sell_filled_at", "updated_at", "buy_filled_at")
    minutes = F.greatest(F.floor((F.unix_micros(end) - F.unix_micros("buy_filled_at")) / 60_000_000), F.lit(0))
    return stats.kaplan_meier(c.select("bot_id", minutes.alias("duration"), F.col("sell_filled_at").isNotNull().alias("event")), ["bot_id"])


def sale_probability(spark: SparkSession, d: str) -> DataFrame:
    """Per bot the probability of a sale within a day of the buy (Kaplan-Meier)."""
    c = _cycles(spark, d).where("buy_filled_at is not null")
    end = F.coalesce("sell_filled_at", "updated_at", "buy_filled_at")
    seconds = (F.unix_micros(end) - F.unix_micros("buy_filled_at")) / 1e6
    return stats.horizon_probability(c.select("bot_id", seconds.alias("duration"), F.col("sell_filled_at").isNotNull().alias("event")), ["bot_id"], 86400.0)


def setting_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous stretches of one ATR window per bot."""
    c = _cycles(spark, d).withColumn("atr_window", F.concat_ws("x", F.coalesce(F.col("atr_period").cast("string"), F.lit("?")), F.coalesce(F.col("atr_bar_seconds").cast("string"), F.lit("?"))))
    return stats.islands(c, ["bot_id"], ["cycle_number", "id"], "atr_window")


def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Largest fall of each bot's running result from its peak, on 10,000 of capital."""
    w = Window.partitionBy("bot_id").orderBy("created_at", "id")
    r = _cycles(spark, d).where("net_pnl is not null").withColumn("equity", 10000 + F.sum("net_pnl").over(w)).where("equity > 0")
    return stats.drawdown(r, ["bot_id"], ["created_at", "id"], "equity")


def pareto_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Tickers no other ticker dominates in median return, closed cycles (more is better) and spread of returns (less)."""
    r = _returns(spark, d).groupBy("ticker").agg(F.round(F.median("value"), 9).alias("median"), F.count(F.lit(1)).alias("cycles"), F.round(F.max("value") - F.min("value"), 9).alias("spread"))
    return stats.pareto_front(r, "ticker", ["median", "cycles"], ["spread"])


def leave_own_out(spark: SparkSession, d: str) -> DataFrame:
    """Per fill: the mean commission rate of its symbol and side without its own cycle."""
    f = _fills(spark, d).where("commission > 0 and notional > 0").withColumn("bps", F.col("commission") / F.col("notional") * 10000)
    g, o = Window.partitionBy("e", "side"), Window.partitionBy("e", "side", "cycle_id")
    f = f.withColumns({"_s": F.sum("bps").over(g) - F.sum("bps").over(o), "_n": F.count("bps").over(g) - F.count("bps").over(o)})
    return f.select("id", F.try_divide("_s", "_n").alias("others_bps"), F.col("_n").alias("others"))


def grid_regions(spark: SparkSession, d: str) -> DataFrame:
    """Connected regions, of three points and more, of the settings grid whose share of gains is at least half the best."""
    c = _cycles(spark, d).where("net_pnl is not null")
    step = lambda n: (F.round(F.col(n) * 2) / 2).alias(n)
    g = c.groupBy(step("initial_drop_pct"), step("rise_trigger_pct")).agg(F.avg(F.when(F.col("net_pnl") > 0, 100.0).otherwise(0.0)).alias("score"))
    return grids.near_best_regions(g.where("initial_drop_pct is not null and rise_trigger_pct is not null"), ["initial_drop_pct", "rise_trigger_pct"], "score", 0.5, share=0.5)


def chosen_fragments(spark: SparkSession, d: str) -> DataFrame:
    return fragments.best_fragments(table(spark, d, "fragments"))


def data_through(spark: SparkSession, d: str) -> DataFrame:
    """The latest instant of any evidence."""
    parts = [table(spark, d, "ticks").agg(F.max(F.unix_micros("captured_at_utc")).alias("t")), table(spark, d, "cycles").agg(F.greatest(F.max(F.unix_micros("updated_at")), F.max(F.unix_micros("created_at"))).alias("t")), _fills(spark, d).agg(F.max("t").alias("t"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("t").alias("through_us"))


def ticker_union(spark: SparkSession, d: str) -> DataFrame:
    """Tickers of cycles and of executions, and in which of them they stand."""
    a = table(spark, d, "cycles").select(F.upper(F.trim("ticker")).alias("ticker"), F.lit(True).alias("c"), F.lit(False).alias("x"))
    b = table(spark, d, "executions").select(F.upper(F.trim("ticker")).alias("ticker"), F.lit(False).alias("c"), F.lit(True).alias("x"))
    return a.unionByName(b).groupBy("ticker").agg(F.bool_or("c").alias("in_cycles"), F.bool_or("x").alias("in_executions"))


def symbols_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that both traded and were recorded (intersection)."""
    return table(spark, d, "executions").select(F.upper(F.trim("ticker")).alias("symbol")).intersect(table(spark, d, "ticks").select("symbol"))


def setting_checks(spark: SparkSession, d: str) -> DataFrame:
    """Scalar rules on every cycle: held percentage and its state, price on the grid, names, next trading day."""
    c = _cycles(spark, d)
    e = scalars.effective_pct(F.col("atr_min_pct"), F.lit(1.5), F.lit(0.2), F.lit(1.0))
    return c.select("id", e["pct"].alias("pct"), e["state"].alias("state"), scalars.to_increment(F.col("avg_buy_price"), F.lit(0.05), True).alias("up"), scalars.to_increment(F.col("avg_buy_price"), F.lit(0.05), False).alias("down"),
        scalars.next_weekday(F.to_date("created_at")).alias("next_day"), scalars.safe_name(F.concat_ws(" / ", "ticker", "stage")).alias("folder"), scalars.block_length(F.col("cycle_number")).alias("blocks"))


def hash_draws(spark: SparkSession, d: str) -> DataFrame:
    """Repeatable draws for every cycle."""
    return _cycles(spark, d).select("id", scalars.hash_index(F.lit(SEED), F.col("cycle_number"), F.col("id"), F.lit(1000)).cast("long").alias("draw"))


QUERIES = {
    f.__name__: f
    for f in (fills_once, order_groups, allocated_commissions, commission_percentiles, cross_fitted_costs, cycle_fills, fills_without_cycle, completed_cycles, pnl_summary, return_scores, return_bootstrap, return_leave_one_out,
              block_bootstrap, walk_forward_folds, hold_survival, sale_probability, setting_regimes, equity_drawdown, pareto_tickers, leave_own_out, grid_regions, chosen_fragments, data_through, ticker_union, symbols_recorded, setting_checks, hash_draws)
}

_C = C.replace("net_pnl := net_pnl,", "net_pnl := net_pnl, gross_pnl := gross_pnl, initial_drop_pct := initial_drop_pct, atr_min_pct := atr_min_pct,")
_O = """o as (select cycle_id, side, coalesce(nullif(trim(order_ref), ''), cycle_id || '/' || side) as order_key, count(*) as fills, sum(shares) as quantity, sum(notional) as notional, sum(commission) as commission, min(t) as first_t, max(t) as last_t, sum(notional) / nullif(sum(shares), 0) as vwap from x group by 1, 2, 3)"""
_R = "r as (select id, bot_id, ticker, cast(created_at as date) as day, net_pnl / (buy_filled_qty * avg_buy_price) * 10000 as value, created_at, sell_filled_at from c where net_pnl is not null and buy_filled_qty > 0 and avg_buy_price > 0)"
_D = "d as (select bot_id, day, sum(value) as s, count(value) as c from r group by 1, 2)"
_Q = "case q when {0} then quantile_cont(m, {0}) end"

SQL = {
    "fills_once": f"with {X} select id, e, side, t, notional, commission from x",
    "order_groups": f"with {X}, {_O} select * from o",
    "allocated_commissions": f"""with {X}, {_O}, {_C}, k as (select id as cycle_id, (gross_pnl - net_pnl) / 2 as total, unnest(['BOT', 'SLD']) as side from c where gross_pnl - net_pnl > 0),
j as (select o.*, total, sum(notional) over (partition by o.cycle_id, o.side) as every from o left join k on o.cycle_id = k.cycle_id and o.side = k.side)
select cycle_id, side, order_key, case when total > 0 then total * notional / nullif(every, 0) else commission end as allocated from j""",
    "commission_percentiles": f"with {X}, y as (select *, commission / notional * 10000 as v from x where commission > 0 and notional > 0) select e, side, count(v) as n, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90 from y group by 1, 2",
    "cross_fitted_costs": f"""with {X}, y as (select e as key, day, count(*) as n, avg(commission / notional * 10000) as cost from x where commission > 0 and notional > 0 group by 1, 2),
j as (select a.key, a.day, a.n, coalesce(sum(b.n) filter (b.day < a.day), 0) as pn, sum(b.n * b.cost) filter (b.day < a.day) as ps, sum(b.n) filter (b.day <> a.day) as qn, sum(b.n * b.cost) filter (b.day <> a.day) as qs from y a join y b using (key) group by 1, 2, 3)
select key, day, n, greatest(1.0, case when pn >= 20 then ps / pn when qn > 0 then 1.0 + least(1.0, qn / 20.0) * (qs / qn - 1.0) else 1.0 end) as assumed from j""",
    "cycle_fills": f"""with {X}, {C}, v as (select cycle_id, sum(shares) as q, sum(notional) / nullif(sum(shares), 0) as vwap, max(t) as t from x where side = 'BOT' group by 1)
select id, case when buy_filled_qty > 0 and avg_buy_price > 0 then buy_filled_qty else q end as quantity, case when buy_filled_qty > 0 and avg_buy_price > 0 then avg_buy_price else vwap end as price, coalesce(epoch_us(buy_filled_at), t) as filled_t, q is null as no_fills from c left join v on c.id = v.cycle_id""",
    "fills_without_cycle": f"with {X} select id, cycle_id from x where cycle_id is null or cycle_id not in (select id from cycles where id is not null)",
    "completed_cycles": f"""with {C} select id, stage like '%CYCLE_COMPLETE' or coalesce(buy_filled_qty > 0 and greatest(coalesce(sell_filled_qty, 0), coalesce(protective_sell_filled_qty, 0)) >= buy_filled_qty - greatest(1e-8, buy_filled_qty * 1e-9), false) as completed from c""",
    "pnl_summary": f"with {C} select bot_id, ticker, count(*) as cycles, count(net_pnl) as closed, median(net_pnl) as median_pnl, sum(net_pnl) as net_pnl, grouping(ticker)::int as all_tickers from c group by grouping sets ((bot_id), (bot_id, ticker))",
    "return_scores": f"""with {C}, {_R}, p(policy, a, b, w, dd, o) as (values {', '.join(str(x) for x in POLICIES)}),
g as (select ticker, median(value) as md, avg(value) as mn, min(value) as ws, max(greatest(-value, 0)) as dr, avg(case when sell_filled_at is null then 1.0 else 0.0 end) as os, count(*) as n from r group by 1)
select ticker, policy, n, a::double * md + b::double * mn + w::double * ws - dd::double * dr - o::double * os as score from g, p""",
    "return_bootstrap": f"""with {C}, {_R}, e as (select bot_id, day, row_number() over (partition by bot_id order by day) - 1 as i, count(*) over (partition by bot_id) as k from (select distinct bot_id, day from r)),
h as (select bot_id, rep, (cast('0x' || left(sha256('{SEED}|' || rep || '|' || i), 16) as ubigint) % k)::bigint as i from e, range({REPLICATES}) as z(rep) where k >= 3),
m as (select h.bot_id, rep, median(value) as m from h join e on h.bot_id = e.bot_id and h.i = e.i join r on r.bot_id = e.bot_id and r.day = e.day group by 1, 2),
ci as (select bot_id, quantile_cont(m, 0.025) as lo95, quantile_cont(m, 0.1) as lo80, quantile_cont(m, 0.9) as hi80, quantile_cont(m, 0.975) as hi95, avg(case when m > 0 then 1.0 else 0.0 end) as positive from m group by 1)
select bot_id, b.days, b.median, lo95, lo80, hi80, hi95, positive from ci join (select bot_id, count(distinct day) as days, median(value) as median from r group by 1) b using (bot_id)""",
    "return_leave_one_out": f"""with {C}, {_R}, e as (select o.bot_id, o.day as omitted, median(r.value) as e from (select distinct bot_id, day from r) o join r on r.bot_id = o.bot_id and r.day <> o.day group by 1, 2),
f as (select bot_id, median(value) as median, count(distinct day) as k from r group by 1), j as (select *, round(abs(e - median), 9) as move from e join f using (bot_id) where k >= 3)
select bot_id, count(*) as days, min(e) as lowest, median(e) as middle, max(e) as highest, count(*) filter (abs(median) > 1e-12 and e <> 0 and sign(e) <> sign(median)) as sign_reversals, max_by(omitted, struct_pack(a := move, b := -(omitted - date '1970-01-01'))) as influential_day from j group by 1""",
    "walk_forward_folds": f"""with {C}, {_R}, y as (select day, sum(value) as s, count(*) as c, row_number() over (order by day) - 1 as unit, count(*) over () as n from r group by 1),
f as (select (a - greatest(2, n // 2))::int as fold, a as train_end, a + 1 as valid_end from (select distinct n from y), range(0, 1000) as z(a) where a >= greatest(2, n // 2) and a < n)
select fold, sum(s) filter (unit < train_end) / sum(c) filter (unit < train_end) as train, sum(s) filter (unit >= train_end) / sum(c) filter (unit >= train_end) as validate from y join f on unit < valid_end group by 1""",
    "hold_survival": f"""with {C}, y as (select bot_id, greatest((epoch_us(coalesce(sell_filled_at, updated_at, buy_filled_at)) - epoch_us(buy_filled_at)) // 60000000, 0) as duration, sell_filled_at is not null as event from c where buy_filled_at is not null),
g as (select bot_id, duration, count(*) filter (event) as events, count(*) as n from y group by 1, 2), h as (select *, sum(n) over (partition by bot_id order by duration desc) as at_risk from g)
select bot_id, duration, at_risk, events, product(1 - events / at_risk) over (partition by bot_id order by duration) as survival from h where events > 0""",
    "sale_probability": f"""with {C}, y as (select bot_id, (epoch_us(coalesce(sell_filled_at, updated_at, buy_filled_at)) - epoch_us(buy_filled_at)) / 1e6 as duration, sell_filled_at is not null as event from c where buy_filled_at is not null), z as (select * from y where duration >= 0),
g as (select bot_id, duration, count(*) filter (event and duration <= 86400) as events, count(*) as n from z group by 1, 2), h as (select *, sum(n) over (partition by bot_id order by duration desc) as at_risk from g),
k as (select bot_id, product(1 - events / at_risk) as s, max(duration) as longest from h group by 1) select bot_id, case when s = 0 or longest >= 86400 then (1 - s) * 100 end as probability from k""",
    "setting_regimes": f"""with {C}, y as (select bot_id, cycle_number, id, coalesce(atr_period::varchar, '?') || 'x' || coalesce(atr_bar_seconds::varchar, '?') as atr_window from c), z as (select *, lag(atr_window) over (partition by bot_id order by cycle_number, id) as p from y),
q as (select *, (sum(case when p = atr_window then 0 else 1 end) over (partition by bot_id order by cycle_number, id))::int as regime from z) select bot_id, regime, any_value(atr_window) as atr_window, count(*) as rows, min(cycle_number) as first, max(cycle_number) as last from q group by 1, 2""",
    "equity_drawdown": f"""with {C}, y as (select bot_id, created_at, id, 10000 + sum(net_pnl) over (partition by bot_id order by created_at, id) as equity from c where net_pnl is not null), z as (select *, max(equity) over (partition by bot_id order by created_at, id) as peak from y where equity > 0)
select bot_id, max((peak - equity) / peak * 10000) as max_drawdown_bps, (max_by(equity, struct_pack(a := created_at, b := id)) / min_by(equity, struct_pack(a := created_at, b := id)) - 1) * 10000 as return_bps from z group by 1""",
    "pareto_tickers": f"""with {C}, {_R}, g as (select ticker, round(median(value), 9) as median, count(*) as cycles, round(max(value) - min(value), 9) as spread from r group by 1)
select * from g a where not exists (select 1 from g b where b.median >= a.median and b.cycles >= a.cycles and b.spread <= a.spread and (b.median > a.median or b.cycles > a.cycles or b.spread < a.spread))""",
    "leave_own_out": f"""with {X}, y as (select *, commission / notional * 10000 as bps from x where commission > 0 and notional > 0), z as (select id, sum(bps) over g - sum(bps) over o as s, count(bps) over g - count(bps) over o as n from y window g as (partition by e, side), o as (partition by e, side, cycle_id))
select id, s / nullif(n, 0) as others_bps, n as others from z""",
    "grid_regions": f"""with recursive {_C}, g as (select round(initial_drop_pct * 2) / 2 as x, round(rise_trigger_pct * 2) / 2 as y, avg(case when net_pnl > 0 then 100.0 else 0.0 end) as score from c
  where net_pnl is not null and initial_drop_pct is not null and rise_trigger_pct is not null group by 1, 2),
n as (select *, row_number() over (order by x, y) as id from g where score >= (select max(score) - greatest(2, 0.5::double * abs(max(score))) from g)),
e as (select a.id as a, b.id as b from n a join n b on (a.x = b.x and abs(a.y - b.y) <= 0.5 + 1e-9) or (a.y = b.y and abs(a.x - b.x) <= 0.5 + 1e-9)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a), l as (select a as id, min(b) as root from r group by 1),
k as (select root, count(*) as c, min(score) as worst, min(struct_pack(x := x, y := y)) as least, median(x) as mx, median(y) as my from l join n using (id) group by 1 having count(*) >= 3),
o as (select *, (row_number() over (order by worst desc, least) - 1)::int as region from k), z as (select region, n.*, row_number() over (partition by region order by round(abs(x - mx) + abs(y - my), 9), score desc, x, y) as place from o join l using (root) join n using (id))
select region, x as initial_drop_pct, y as rise_trigger_pct, score, place = 1 as centre from z""",
    "data_through": f"with {X} select greatest((select max(epoch_us(captured_at_utc)) from ticks), (select greatest(max(epoch_us(updated_at)), max(epoch_us(created_at))) from cycles), (select max(t) from x)) as through_us",
    "ticker_union": "with u as (select upper(trim(ticker)) as ticker, true as c, false as x from cycles union all select upper(trim(ticker)), false, true from executions) select ticker, bool_or(c) as in_cycles, bool_or(x) as in_executions from u group by 1",
    "symbols_recorded": "select upper(trim(ticker)) as symbol from executions intersect select symbol from ticks",
    "setting_checks": f"""with {_C} select id, round(case when not coalesce(atr_min_pct > 0, false) then null when atr_min_pct * 1.5::double <= 0.2::double then 0.2::double when atr_min_pct * 1.5::double >= 1 then 1 else atr_min_pct * 1.5::double end, 2) as pct,
  case when not coalesce(atr_min_pct > 0, false) then 'unavailable' when atr_min_pct * 1.5::double <= 0.2::double then 'min' when atr_min_pct * 1.5::double >= 1 then 'max' else 'raw' end as state,
  case when avg_buy_price is not null then round(greatest(0.05::double, ceil(avg_buy_price / 0.05::double - 1e-12) * 0.05::double), 2) end as up, case when avg_buy_price is not null then round(greatest(0.05::double, floor(avg_buy_price / 0.05::double + 1e-12) * 0.05::double), 2) end as down,
  (cast(created_at as date) + (case dayofweek(created_at) when 5 then 3 when 6 then 2 else 1 end)::int)::date as next_day,
  regexp_replace(regexp_replace(ticker || ' / ' || stage, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as folder, (case when cycle_number < 15 then null when cycle_number < 30 then 2 when cycle_number < 60 then 3 else least(5, greatest(3, round(cbrt(cycle_number)))) end)::int as blocks from c""",
    "hash_draws": f"with {C} select id, (cast('0x' || left(sha256('{SEED}|' || cycle_number || '|' || id), 16) as ubigint) % 1000)::bigint as draw from c",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "fills_once": ["notional", "commission"],
    "order_groups": ["quantity", "notional", "commission", "vwap"],
    "allocated_commissions": ["allocated"],
    "commission_percentiles": ["p50", "p75", "p90"],
    "cross_fitted_costs": ["assumed"],
    "cycle_fills": ["quantity", "price"],
    "pnl_summary": ["median_pnl", "net_pnl"],
    "return_scores": ["score"],
    "return_bootstrap": ["median", "lo95", "lo80", "hi80", "hi95", "positive"],
    "return_leave_one_out": ["lowest", "middle", "highest"],
    "walk_forward_folds": ["train", "validate"],
    "hold_survival": ["survival"],
    "grid_regions": ["score"],
    "sale_probability": ["probability"],
    "equity_drawdown": ["max_drawdown_bps", "return_bps"],
    "pareto_tickers": ["median", "spread"],
    "leave_own_out": ["others_bps"],
    "setting_checks": ["pct", "up", "down"],
}
