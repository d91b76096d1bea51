"""Queries of matching, evidence, selection and grids, and SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, evidence, grids, intervals, orders, quality, quotes, stats, triggers
from ..sinks import recordings
from ..sources import recording
from ..util import materialize, shared_dir, table
from .market_queries import SQL as MARKET
from .market_queries import _BUY, _POINTS, C, HALF_HOUR_US, T, X, _buys, _points, _prices, _ticks, cycles_once, fill_quotes
from .order_queries import REPLICATES, SEED, _R, _returns

#: Samples a cost needs, and the least cost in basis points.
MINIMUM, FLOOR = 20, 1.0
#: Settings whose hundredths make up a profile.
SETTINGS = ["initial_drop_pct", "buy_rebound_trail_pct", "rise_trigger_pct", "sell_trailing_stop_pct", "atr_period", "atr_bar_seconds"]
#: Extra costs in basis points and weight of the worst day, one assumption a row.
STRESSES = [("base", 0.0, 0.0), ("cost_2", 2.0, 0.0), ("cost_5", 5.0, 0.0), ("cost_10", 10.0, 0.0), ("worst", 0.0, 0.25), ("worst_cost_5", 5.0, 0.25)]


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    return cycles_once(table(spark, d, "cycles"))


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return orders.fills_once(table(spark, d, "executions"))


def capture_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle's first fill with the capture file of its cycle that is nearest in time: 0 inside the file's points, else
    the distance to its first or last (ties: the file name). Files are compared by their bounds, not point by point."""
    f = _fills(spark, d).where("cycle_id is not null and t is not null").groupBy("cycle_id").agg(F.min("t").alias("t"))
    p = _points(spark, d).join(table(spark, d, "capture_lines").select("line_id", "file_name"), "line_id")
    files = p.groupBy("cycle_id", "file_name").agg(F.min(F.unix_micros("captured_at_utc")).alias("a"), F.max(F.unix_micros("captured_at_utc")).alias("z"))
    away = F.greatest(F.lit(0), F.col("a") - F.col("t"), F.col("t") - F.col("z"))
    best = f.join(files, "cycle_id").groupBy("cycle_id").agg(F.min(F.struct((away / 1e6).alias("away_s"), "file_name")).alias("x"), F.count(F.lit(1)).alias("candidates"))
    return best.select("cycle_id", "x.file_name", "x.away_s", "candidates")


def order_times(spark: SparkSession, d: str) -> DataFrame:
    """When each cycle's buy order first filled: by its reference where the cycle names one (none found: no time, no other
    order stands in), else the first buy of the cycle."""
    c = _cycles(spark, d).select("id", F.nullif(F.trim("buy_order_ref"), F.lit("")).alias("ref"))
    f = _fills(spark, d).where("side = 'BOT'")
    by_ref = f.groupBy(F.col("cycle_id").alias("id"), F.trim("order_ref").alias("ref")).agg(F.min("t").alias("ref_t"))
    first = f.groupBy(F.col("cycle_id").alias("id")).agg(F.min("t").alias("any_t"))
    j = c.join(by_ref, ["id", "ref"], "left").join(first, "id", "left")
    return j.select("id", F.when(F.col("ref").isNotNull(), F.col("ref_t")).otherwise(F.col("any_t")).alias("order_t"), F.col("ref").isNotNull().alias("by_reference"))


def contract_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each instrument's sessions: those of its con_id where there are any, else those of its symbol, never both."""
    i = table(spark, d, "instruments").groupBy("con_id").agg(F.min(F.upper("symbol")).alias("symbol"))
    s = quality.sessions_once(table(spark, d, "sessions")).select("session_id", F.col("con_id").alias("s_con"), F.upper("symbol").alias("s_sym"))
    exact = s.groupBy("s_con").agg(F.count(F.lit(1)).alias("exact"))
    named = s.groupBy("s_sym").agg(F.count(F.lit(1)).alias("named"))
    j = i.join(exact, i["con_id"] == exact["s_con"], "left").join(named, i["symbol"] == named["s_sym"], "left")
    return j.select("con_id", F.coalesce("exact", "named", F.lit(0)).alias("sessions"), F.when(F.col("exact").isNotNull(), "con_id").when(F.col("named").isNotNull(), "symbol").otherwise("none").alias("matched_by"))


def fragment_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with the period of their contract's session on that date, whichever way the date is spelled; 0 without one."""
    s = quality.sessions_once(table(spark, d, "sessions")).withColumn("day", scalars.session_day(F.col("session_date")))
    s = s.where("day is not null").groupBy("con_id", "day").agg(F.min("period_id").alias("period"))
    f = table(spark, d, "fragments").where("fragment_id is not null").groupBy("fragment_id").agg(F.min("con_id").alias("con_id"), F.min(scalars.session_day(F.col("session_date"))).alias("day"))
    return f.join(s, ["con_id", "day"], "left").select("fragment_id", F.coalesce("period", F.lit(0)).alias("period"))


def fragment_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Per contract and date whether all pieces come from one recording: single, mixed, or unresolved where a piece has no fingerprint."""
    f = table(spark, d, "fragments").select("con_id", scalars.session_day(F.col("session_date")).alias("day"), "fingerprint")
    g = f.groupBy("con_id", "day").agg(F.count(F.lit(1)).alias("pieces"), F.count("fingerprint").alias("known"), F.count_distinct("fingerprint").alias("sources"))
    return g.select("con_id", "day", "pieces", "sources", F.when(F.col("known") < F.col("pieces"), "unresolved").when(F.col("sources") == 1, "single").otherwise("mixed").alias("provenance"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    cents = [F.coalesce(F.round(F.col(c).cast("double") * 100).cast("long").cast("string"), F.lit("?")) for c in SETTINGS]
    known = F.coalesce(*SETTINGS[:2]).isNotNull() & F.col("atr_period").isNotNull()
    return _cycles(spark, d).select("id", "bot_id", "cycle_number", F.when(known, F.substring(F.sha2(F.concat_ws("/", *cents), 256), 1, 10)).alias("profile"))


def cycle_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle's settings as a profile id, the leading digits of their hash; none where the settings are not known."""
    return _profiles(spark, d).select("id", "profile")


def setting_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per bot how often its known profile changed from cycle to cycle."""
    return evidence.changes_of_known(_profiles(spark, d), ["bot_id"], ["cycle_number", "id"], "profile")


def after_exit_until_buy(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and highest bid after each sale, up to five minutes or the next buy of the symbol, whichever comes first."""
    f = _fills(spark, d).where("e is not null and t is not null")
    x = evidence.until_next(f.where("side = 'SLD'").select("id", "e", "t", "price"), f.where("side = 'BOT'").select("e", "t"), ["e"], 300_000_000)
    b = _ticks(spark, d).where("vbid is not null").select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), "vbid")
    j = asof.forward_range(x, b, ["e"], 300_000_000).where("t < until or (t = until and until = left_t + 300000000)")
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("quotes"), F.min("vbid").alias("lowest"), F.max("vbid").alias("highest"))


def overnight_units(spark: SparkSession, d: str) -> DataFrame:
    """Per bot the stretches of days that positions held overnight link together; a day without any stands alone."""
    c = _cycles(spark, d).where("buy_filled_at is not null").select("bot_id", F.unix_date(F.to_date("buy_filled_at")).alias("a"), F.unix_date(F.to_date(F.coalesce("sell_filled_at", "updated_at", "buy_filled_at"))).alias("z"))
    p = intervals.periods_and_gaps(c, ["bot_id"], F.col("a"), F.col("z")).where("kind = 'period'")
    return p.select("bot_id", F.date_from_unix_date(F.col("start_ms").cast("int")).alias("first_day"), F.date_from_unix_date(F.col("end_ms").cast("int")).alias("last_day"))


def weighted_days(spark: SparkSession, d: str) -> DataFrame:
    """Per ticker median and mean return when each day counts as often as its weight, here 1 to 3 by the day's number."""
    r = _returns(spark, d).withColumn("w", F.day("day") % 3 + 1)
    return r.groupBy("ticker").agg(F.sum("w").cast("long").alias("weight"), F.percentile("value", 0.5, F.col("w")).alias("median"), (F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("mean"))


def fill_samples(spark: SparkSession, d: str) -> DataFrame:
    """One sample per fill out of its repeats: the most complete, marked where prices or commissions contradict."""
    x = table(spark, d, "executions").select("id", "price", "commission", "shares", "order_ref", "commission_currency", F.coalesce("executed_at", F.lit("")).alias("stamp"), F.coalesce("ticker", F.lit("")).alias("name"))
    s = evidence.clean_samples(x, "id", {"price": 1e-9, "commission": 1e-9}, ["price", "commission", "order_ref", "commission_currency"], ["stamp", "name"])
    return s.select("id", "copies", "conflict", "stamp", "price")


def execution_model(spark: SparkSession, d: str) -> DataFrame:
    """Per side of the fills: samples, median age of the quote, and median and 75th percentile of the adverse slippage up to 1000 bps."""
    q = fill_quotes(spark, d).where("slippage_bps <= 1000")
    g = q.groupBy("side").agg(F.count(F.lit(1)).alias("samples"), F.percentile("age_s", 0.5).alias("age_p50"), F.percentile("slippage_bps", F.array(F.lit(0.5), F.lit(0.75))).alias("_p"))
    return g.select("side", "samples", "age_p50", F.col("_p")[0].alias("slippage_p50"), F.col("_p")[1].alias("slippage_p75"))


def _costed(spark: SparkSession, d: str) -> DataFrame:
    f = _fills(spark, d).where("notional > 0").select("id", "e", "side", "cycle_id", "order_ref", "notional", F.when(F.col("commission") >= 0, F.col("commission") / F.col("notional") * 10000).alias("commission"))
    return f.join(fill_quotes(spark, d).select("id", F.col("slippage_bps").alias("slippage")), "id", "left").withColumn("total", F.col("commission") + F.col("slippage"))


def supported_costs(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol and side the cost to assume, and which measure has samples enough to carry it."""
    names = ("total", "slippage", "commission")
    g = _costed(spark, d).groupBy("e", "side").agg(*[F.count(c).alias(f"n_{c}") for c in names], *[F.percentile(c, 0.75).alias(c) for c in names])
    return evidence.supported_cost(g, MINIMUM, FLOOR).select("e", "side", "source", "cost", *[f"n_{c}" for c in names])


def order_slippage(spark: SparkSession, d: str) -> DataFrame:
    """Per order the slippage of its fills weighted by their notional, and the share of the notional that has a quote."""
    ref = F.coalesce(F.nullif(F.trim("order_ref"), F.lit("")), F.concat_ws("/", "cycle_id", "side")).alias("order_key")
    g = _costed(spark, d).groupBy("cycle_id", "side", ref).agg(F.sum(F.when(F.col("slippage").isNotNull(), F.col("notional"))).alias("quoted"), F.sum("notional").alias("notional"), F.sum(F.col("slippage") * F.col("notional")).alias("_s"))
    return g.select("cycle_id", "side", "order_key", F.try_divide("_s", "quoted").alias("slippage_bps"), (F.coalesce("quoted", F.lit(0.0)) / F.col("notional") * 100).alias("quoted_pct"))


def selection_stability(spark: SparkSession, d: str) -> DataFrame:
    """Per ticker the bot with the best mean return, and how often it is chosen again when a day is left out."""
    return evidence.selection_stability(_returns(spark, d), "ticker", "bot_id", "day", "value")


def selection_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The bot chosen on drawn days, scored on the days that were not drawn."""
    return evidence.selection_bootstrap(_returns(spark, d), "bot_id", "day", "value", SEED)


def walk_forward_selection(spark: SparkSession, d: str) -> DataFrame:
    """The bot chosen on all days so far, scored on the next two."""
    return evidence.walk_forward_selection(_returns(spark, d), "bot_id", "day", "value", 3, 2)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d)
    control = F.broadcast(r.agg(F.min("bot_id").alias("_control")))  # one row
    return evidence.pairs_with_control(r.join(control), "bot_id", F.col("bot_id") == F.col("_control"), ["ticker", "day"], "value", ["_control"])


def paired_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every bot against the first on days and tickers that both have exactly once: intervals of the median difference."""
    return stats.day_bootstrap(_deltas(spark, d).withColumnRenamed("delta", "value"), ["bot_id"], SEED, REPLICATES)


def paired_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return stats.leave_one_day_out(_deltas(spark, d).withColumnRenamed("delta", "value"), ["bot_id"])


def stressed_returns(spark: SparkSession, d: str) -> DataFrame:
    """Per ticker and assumption: the median return less its extra cost and its weight of the worst day."""
    r = _returns(spark, d).groupBy("ticker").agg(F.median("value").alias("m"), F.min("value").alias("w"))
    s = F.broadcast(spark.createDataFrame(STRESSES, "assumption string, cost double, worst double"))  # a handful of rows
    return r.join(s).select("ticker", "assumption", (F.col("m") - F.col("cost") + F.col("worst") * F.least("w", F.lit(0.0))).alias("score"))


def leaf_checks(spark: SparkSession, d: str) -> DataFrame:
    """Normalised settings of every cycle, the price that arms its sale, and what its sale gained on that."""
    c = _cycles(spark, d)
    n = c.select(
        "id", scalars.multiplier(F.col("initial_drop_pct")).alias("drop_x"), scalars.window_part(F.col("atr_period"), 2, 200).alias("period"), scalars.window_part(F.col("atr_bar_seconds"), 5, 3600).alias("bar_s"),
        scalars.required_sale(F.col("avg_buy_price"), F.col("rise_trigger_pct"), F.col("sell_trailing_stop_pct")).alias("required"), "avg_sell_price", "sell_filled_at", "created_at",
    )
    gain = scalars.improvement_bps(F.col("avg_sell_price"), F.col("required"), F.lit("SLD"))
    return n.select("id", "drop_x", "period", "bar_s", "required", gain.alias("gain_bps"), scalars.adverse_residual(-gain).alias("adverse_bps"))


def setting_grids(spark: SparkSession, d: str) -> DataFrame:
    """All grids of the staged search as rows: protective policies, windows, the coarse grid, and neighbours of its corners."""
    policy = grids.policy_grid(spark).select(F.lit("policy").alias("grid"), F.concat_ws("/", "mode", F.col("value").cast("string")).alias("point"))
    text = lambda df, *cols: F.concat_ws("/", *[F.format_string("%.2f", F.col(c).cast("double")) for c in cols])
    w = grids.window_grid(spark)
    window = w.select(F.lit("window").alias("grid"), text(w, "period", "bar_seconds", *grids.AXES).alias("point"))
    g = grids.coarse_grid(spark)
    coarse = g.select(F.lit("coarse").alias("grid"), text(g, *grids.AXES, "min_pct").alias("point"))
    seeds = g.where("initial_x = 0.75 and sell_x = 0.0 and min_pct = 0.01")
    fine = grids.refined_grid(seeds)
    refined = fine.select(F.lit("refined").alias("grid"), text(fine, *grids.AXES, "min_pct").alias("point"))
    return policy.unionByName(window).unionByName(coarse).unionByName(refined)


def best_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per bot: contiguous runs of steps of the drop, half a percent each, whose mean return is near the best, and each
    run's centre."""
    r = _returns(spark, d).join(_cycles(spark, d).select("id", F.round(F.col("initial_drop_pct") * 2).cast("long").alias("step")), "id").where("step is not null")
    g = r.groupBy("bot_id", "step").agg(F.avg("value").alias("score"))
    return grids.near_best_runs(g, ["bot_id"], "step", "score", 1)


def buy_observations(spark: SparkSession, d: str) -> DataFrame:
    """What the replay of each cycle's buy shows: triggered, right_censored (the data or the horizon end first), or unavailable
    without a price; whether its start lies before the symbol's first price; and the seconds until the trigger or the last
    price seen."""
    prices = _prices(spark, d)
    b = _buys(spark, d)
    path = triggers.paths(b, prices, HALF_HOUR_US)
    hit = triggers.first_buy(path, "buy_rebound_trail_pct").select("id", "triggered", "trigger_t")
    seen = path.groupBy("id").agg(F.max("t").alias("last_t"))
    first = prices.groupBy("e").agg(F.min("t").alias("first_t"))
    j = b.select("id", "e", "t").join(hit, "id", "left").join(seen, "id", "left").join(first, "e", "left")
    outcome = F.when(F.col("last_t").isNull(), "unavailable").when(F.col("triggered"), "triggered").otherwise("right_censored")
    return j.select("id", outcome.alias("outcome"), F.coalesce(F.col("t") < F.col("first_t"), F.lit(True)).alias("left_censored"), ((F.coalesce("trigger_t", "last_t") - F.col("t")) / 1e6).alias("seconds"))


def observation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per bot: buys by outcome, the median delay of the triggered ones, and the probability of a trigger within fifteen
    minutes (Kaplan-Meier) of what is scoreable: seen from its start, with a price."""
    o = buy_observations(spark, d).join(_cycles(spark, d).select("id", "bot_id"), "id")
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    g = o.groupBy("bot_id").agg(F.count(F.lit(1)).alias("buys"), n("triggered"), n("right_censored"), n("unavailable"), F.count_if("left_censored").alias("left_censored"), F.median(F.when(F.col("outcome") == "triggered", F.col("seconds"))).alias("median_s"))
    ok = o.where("outcome <> 'unavailable' and not left_censored").select("bot_id", F.col("seconds").alias("duration"), (F.col("outcome") == "triggered").alias("event"))
    return g.join(stats.horizon_probability(ok, ["bot_id"], 900.0), "bot_id", "left")


def recorded_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session written as a recording file and read back: its rows, sums, bad rows and broken manifest rules."""
    recording.register(spark)
    t = quotes.clean_ticks(table(spark, d, "ticks"), ["session_id", "tick_id", *recording.TICK_COLUMNS])
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    t = t.select("session_id", *[iso(c) if c in ("captured_at_utc", "source_time_utc") else c for c in recording.TICK_COLUMNS])
    folder = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    written = materialize(recordings.write_recordings(t, folder))
    path = recordings.local_path(folder)
    back = spark.read.format("tick_recording").load(path).groupBy("recording").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("bad_rows"), F.sum("bid").alias("bids"), F.count("last").alias("lasts"), F.max("captured_at_utc").alias("latest")
    )
    info = spark.read.format("recording_info").load(path).select("recording", F.size("problems").alias("problems"), "row_count")
    j = written.join(back.join(info, "recording"), F.col("file") == F.col("recording"))
    return j.where(written["rows"] == F.col("row_count")).select("session_id", back["rows"].alias("readings"), "bad_rows", "bids", "lasts", F.substring("latest", 1, 19).alias("latest"), "problems")


QUERIES = {
    f.__name__: f
    for f in (capture_matches, order_times, contract_sessions, fragment_sessions, fragment_provenance, cycle_profiles, setting_changes, after_exit_until_buy, overnight_units, weighted_days, fill_samples, execution_model,
              supported_costs, order_slippage, selection_stability, paired_evidence, paired_leave_one_out, stressed_returns, leaf_checks, setting_grids, best_runs, recorded_sessions, buy_observations, observation_metrics, selection_bootstrap, walk_forward_selection)
}

_CX = C.replace("net_pnl := net_pnl,", "net_pnl := net_pnl, " + ", ".join(f"{c} := {c}" for c in ("initial_drop_pct", "buy_order_ref")) + ",")
_F = MARKET["fill_quotes"].split("q as (select symbol", 1)[1].join(["q as (select symbol", ""])
_FQ = "fq as (select id, side, quote, " + _F.split("select id, side, quote,", 1)[1] + ")"
_Q = _F.split("\nselect id, side, quote,", 1)[0] + ",\n" + _FQ
_DAY = "coalesce(try_strptime({0}, '%Y%m%d'), try_strptime({0}, '%Y-%m-%d'))::date"
_PROFILE = (
    "pr as (select id, bot_id, cycle_number, case when coalesce(initial_drop_pct, buy_rebound_trail_pct) is not null and atr_period is not null then left(sha256("
    + " || '/' || ".join(f"coalesce(round({c}::double * 100)::bigint::varchar, '?')" for c in SETTINGS)
    + "), 10) end as profile from c)"
)
_COSTED = f"""k0 as (select x.id, x.e, x.side, x.cycle_id, x.order_ref, x.notional, case when x.commission >= 0 then x.commission / x.notional * 10000 end as commission, fq.slippage_bps as slippage from x left join fq using (id) where x.notional > 0),
kt as (select *, commission + slippage as total from k0)"""
_DELTA = """o1 as (select bot_id, ticker, day, max(value) as value from r group by 1, 2, 3 having count(*) = 1), ct as (select min(bot_id) as b from r),
dl as (select a.bot_id, a.ticker, a.day, a.value - b.value as value from o1 a join o1 b on a.ticker = b.ticker and a.day = b.day and b.bot_id = (select b from ct) where a.bot_id <> (select b from ct))"""
_AXIS = lambda *v: "[" + ", ".join(f"{x}::double" for x in v) + "]"

_OBS = f"""{_BUY}, z as (select id, max(t) as last_t from p group by 1), w as (select symbol, min(us) as first_t from t where price is not null group by 1),
ob as (select c.id, c.bot_id, case when z.last_t is null then 'unavailable' when h.x is not null then 'triggered' else 'right_censored' end as outcome, coalesce(epoch_us(c.created_at) < w.first_t, true) as left_censored, (coalesce(h.x.t, z.last_t) - epoch_us(c.created_at)) / 1e6 as seconds
  from c left join h using (id) left join z using (id) left join w on w.symbol = upper(c.ticker) where c.buy_rebound_trail_pct > 0)"""

SQL = {
    "buy_observations": f"with {T}, {_OBS} select id, outcome, left_censored, seconds from ob",
    "observation_metrics": f"""with {T}, {_OBS}, y as (select bot_id, seconds as duration, outcome = 'triggered' and seconds <= 900 as event from ob where outcome <> 'unavailable' and not left_censored and seconds >= 0),
q as (select bot_id, duration, count(*) filter (event) as events, count(*) as n from y group by 1, 2), u as (select *, sum(n) over (partition by bot_id order by duration desc) as at_risk from q),
v as (select bot_id, product(1 - events / at_risk) as s, max(duration) as longest from u group by 1),
g as (select bot_id, count(*) as buys, count(*) filter (outcome = 'triggered') as triggered, count(*) filter (outcome = 'right_censored') as right_censored, count(*) filter (outcome = 'unavailable') as unavailable, count(*) filter (left_censored) as left_censored,
  median(case when outcome = 'triggered' then seconds end) as median_s from ob group by 1) select g.*, case when s = 0 or longest >= 900 then (1 - s) * 100 end as probability from g left join v using (bot_id)""",
    "capture_matches": f"""with {_POINTS}, {X}, f as (select cycle_id, min(t) as t from x where cycle_id is not null and t is not null group by 1),
g as (select pt.cycle_id, l.file_name, min(pt.t) as a, max(pt.t) as z from pt join capture_lines l using (line_id) group by 1, 2)
select f.cycle_id, min_by(file_name, struct_pack(a := greatest(0, a - t, t - z), b := file_name)) as file_name, min(greatest(0, a - t, t - z)) / 1e6 as away_s, count(*) as candidates from f join g using (cycle_id) group by 1""",
    "order_times": f"""with {X}, {_CX}, b as (select * from x where side = 'BOT')
select id, case when nullif(trim(buy_order_ref), '') is not null then (select min(t) from b where b.cycle_id = c.id and trim(b.order_ref) = trim(c.buy_order_ref)) else (select min(t) from b where b.cycle_id = c.id) end as order_t, nullif(trim(buy_order_ref), '') is not null as by_reference from c""",
    "contract_sessions": """with i as (select con_id, min(upper(symbol)) as symbol from instruments group by 1), s as (select distinct session_id, con_id, upper(symbol) as sym from sessions where session_id is not null and symbol is not null),
e as (select con_id, count(distinct session_id) as n from s group by 1), m as (select sym, count(distinct session_id) as n from s group by 1)
select i.con_id, coalesce(e.n, m.n, 0) as sessions, case when e.n is not null then 'con_id' when m.n is not null then 'symbol' else 'none' end as matched_by from i left join e on i.con_id = e.con_id left join m on i.symbol = m.sym""",
    "fragment_sessions": f"""with s as (select con_id, {_DAY.format('session_date')} as day, period_id from sessions where session_id is not null), p as (select con_id, day, min(period_id) as period from s where day is not null group by 1, 2),
f as (select fragment_id, min(con_id) as con_id, min({_DAY.format('session_date')}) as day from fragments where fragment_id is not null group by 1)
select fragment_id, coalesce(period, 0)::int as period from f left join p using (con_id, day)""",
    "fragment_provenance": f"""with g as (select con_id, {_DAY.format('session_date')} as day, count(*) as pieces, count(fingerprint) as known, count(distinct fingerprint) as sources from fragments group by 1, 2)
select con_id, day, pieces, sources, case when known < pieces then 'unresolved' when sources = 1 then 'single' else 'mixed' end as provenance from g""",
    "cycle_profiles": f"with {_CX}, {_PROFILE} select id, profile from pr",
    "setting_changes": f"""with {_CX}, {_PROFILE}, k as (select bot_id, profile, lag(profile) over (partition by bot_id order by cycle_number, id) as p from pr where profile is not null)
select n.bot_id, n.rows, n.known, coalesce(h.changes, 0) as changes from (select bot_id, count(*) as rows, count(profile) as known from pr group by 1) n left join (select bot_id, count(*) filter (p <> profile) as changes from k group by 1) h using (bot_id)""",
    "after_exit_until_buy": f"""with {T}, {X}, s as (select id, e, t, (select min(b.t) from x b where b.side = 'BOT' and b.e = x.e and b.t > x.t) as nb from x where side = 'SLD' and e is not null and t is not null)
select s.id, count(*) as quotes, min(vbid) as lowest, max(vbid) as highest from s join t on t.symbol = s.e and t.us > s.t and t.us <= s.t + 300000000 and (nb is null or t.us < nb or nb > s.t + 300000000) where vbid is not null group by 1""",
    "overnight_units": f"""with {C}, i as (select bot_id, cast(buy_filled_at as date) as a, cast(coalesce(sell_filled_at, updated_at, buy_filled_at) as date) as z from c where buy_filled_at is not null), k as (select distinct * from i where a <= z),
m as (select *, max(z) over (partition by bot_id order by a, z rows between unbounded preceding and 1 preceding) as p from k), g as (select *, sum(case when a <= p then 0 else 1 end) over (partition by bot_id order by a, z rows unbounded preceding) as u from m)
select bot_id, min(a) as first_day, max(z) as last_day from g group by bot_id, u""",
    "weighted_days": f"with {C}, {_R}, w as (select ticker, value, (day(day) % 3 + 1)::int as w from r) select ticker, count(*) as weight, median(value) as median, avg(value) as mean from w, range(1, 4) as z(k) where k <= w.w group by 1",
    "fill_samples": """with g as (select id, count(*) as copies, coalesce(max(price) - min(price) > 1e-9, false) or coalesce(max(commission) - min(commission) > 1e-9, false) as conflict from executions where id is not null group by 1),
k as (select id, price, coalesce(executed_at, '') as stamp, row_number() over (partition by id order by (price is not null)::int + (commission is not null)::int + (order_ref is not null)::int + (commission_currency is not null)::int desc, coalesce(executed_at, ''), coalesce(ticker, '')) as n from executions where id is not null)
select id, copies, conflict, stamp, price from g join k using (id) where n = 1""",
    "execution_model": f"with {T}, {X}, {_Q} select side, count(*) as samples, quantile_cont(age_s, 0.5) as age_p50, quantile_cont(slippage_bps, 0.5) as slippage_p50, quantile_cont(slippage_bps, 0.75) as slippage_p75 from fq where slippage_bps <= 1000 group by 1",
    "supported_costs": f"""with {T}, {X}, {_Q}, {_COSTED}, g as (select e, side, count(total) as n_total, count(slippage) as n_slippage, count(commission) as n_commission, quantile_cont(total, 0.75) as total, quantile_cont(slippage, 0.75) as slippage, quantile_cont(commission, 0.75) as commission from kt group by 1, 2)
select e, side, case when n_total >= {MINIMUM} then 'total' when n_slippage >= {MINIMUM} then 'slippage' when n_commission >= {MINIMUM} then 'commission' else 'none' end as source,
  greatest({FLOOR}::double, case when n_total >= {MINIMUM} then total when n_slippage >= {MINIMUM} then slippage when n_commission >= {MINIMUM} then commission end) as cost, n_total, n_slippage, n_commission from g""",
    "order_slippage": f"""with {T}, {X}, {_Q}, {_COSTED} select cycle_id, side, coalesce(nullif(trim(order_ref), ''), concat_ws('/', cycle_id, side)) as order_key, sum(slippage * notional) / nullif(sum(notional) filter (slippage is not null), 0) as slippage_bps,
  coalesce(sum(notional) filter (slippage is not null), 0) / sum(notional) * 100 as quoted_pct from kt group by 1, 2, 3""",
    "selection_stability": f"""with {C}, {_R}, f as (select ticker, max_by(bot_id, struct_pack(m := m, b := -bot_id)) as chosen from (select ticker, bot_id, round(avg(value), 9) as m from r group by 1, 2) group by 1),
o as (select u.ticker, u.day as omitted, r.bot_id, round(avg(r.value), 9) as m from (select distinct ticker, day from r) u join r on r.ticker = u.ticker and r.day <> u.day group by 1, 2, 3),
p as (select ticker, omitted, max_by(bot_id, struct_pack(m := m, b := -bot_id)) as pick from o group by 1, 2) select ticker, max(chosen) as chosen, count(*) as reruns, avg(case when pick = chosen then 100.0 else 0.0 end) as stability_pct from p join f using (ticker) group by 1""",
    "selection_bootstrap": f"""with {C}, {_R}, u as (select day, row_number() over (order by day) - 1 as i, count(*) over () as k from (select distinct day from r)),
dr as (select rep, (cast('0x' || left(sha256('{SEED}|' || rep || '|' || i), 16) as ubigint) % k)::bigint as i, count(*) as n from u, range(32) as z(rep) group by 1, 2), dd as (select rep, day, n from dr join u using (i)),
m as (select rep, bot_id, sum(n * value) / sum(n) as m from dd join r using (day) group by 1, 2), p as (select rep, max_by(struct_pack(b := bot_id, m := m), struct_pack(m := round(m, 9), b := -bot_id)) as x from m group by 1),
o as (select rep, avg(value) as mean_left_out, count(distinct r.day) as n from p join r on r.bot_id = p.x.b where not exists (select 1 from dd where dd.rep = p.rep and dd.day = r.day) group by 1)
select p.rep::int as rep, x.b as chosen, x.m as mean_drawn, mean_left_out, coalesce(n, 0) as units_left_out from p left join o using (rep)""",
    "walk_forward_selection": f"""with {C}, {_R}, u as (select day, row_number() over (order by day) - 1 as i, count(*) over () as k from (select distinct day from r)), q as (select r.*, i from r join u using (day)),
f as (select fold::int as fold, 3 + 2 * fold as a from (select max(k) as k from u), range(0, 1000) as z(fold) where k >= 5 + 2 * fold),
m as (select fold, bot_id, avg(value) filter (i < a) as t, avg(value) filter (i >= a) as v from q join f on i < a + 2 group by 1, 2), p as (select fold, max_by(struct_pack(b := bot_id, t := t, v := v), struct_pack(m := round(t, 9), b := -bot_id)) as x from m where t is not null group by 1)
select fold, x.b as chosen, x.t as train, x.v as validate from p""",
    "paired_evidence": f"""with {C}, {_R}, {_DELTA}, e as (select bot_id, day, row_number() over (partition by bot_id order by day) - 1 as i, count(*) over (partition by bot_id) as k from (select distinct bot_id, day from dl)),
h as (select bot_id, rep, (cast('0x' || left(sha256('{SEED}|' || rep || '|' || i), 16) as ubigint) % k)::bigint as i from e, range({REPLICATES}) as z(rep) where k >= 3),
m as (select h.bot_id, rep, median(value) as m from h join e on h.bot_id = e.bot_id and h.i = e.i join dl on dl.bot_id = e.bot_id and dl.day = e.day group by 1, 2),
ci as (select bot_id, quantile_cont(m, 0.025) as lo95, quantile_cont(m, 0.1) as lo80, quantile_cont(m, 0.9) as hi80, quantile_cont(m, 0.975) as hi95, avg(case when m > 0 then 1.0 else 0.0 end) as positive from m group by 1)
select bot_id, b.days, b.median, lo95, lo80, hi80, hi95, positive from ci join (select bot_id, count(distinct day) as days, median(value) as median from dl group by 1) b using (bot_id)""",
    "paired_leave_one_out": f"""with {C}, {_R}, {_DELTA}, e as (select o.bot_id, o.day as omitted, median(d.value) as e from (select distinct bot_id, day from dl) o join dl d on d.bot_id = o.bot_id and d.day <> o.day group by 1, 2),
f as (select bot_id, median(value) as median, count(distinct day) as k from dl group by 1), j as (select *, round(abs(e - median), 9) as move from e join f using (bot_id) where k >= 3)
select bot_id, count(*) as days, min(e) as lowest, median(e) as middle, max(e) as highest, count(*) filter (abs(median) > 1e-12 and e <> 0 and sign(e) <> sign(median)) as sign_reversals, max_by(omitted, struct_pack(a := move, b := -(omitted - date '1970-01-01'))) as influential_day from j group by 1""",
    "stressed_returns": f"with {C}, {_R}, s(assumption, cost, worst) as (values {', '.join(str(x) for x in STRESSES)}), g as (select ticker, median(value) as m, min(value) as w from r group by 1) select ticker, assumption, m - cost::double + worst::double * least(w, 0) as score from g, s",
    "leaf_checks": f"""with {_CX}, n as (select id, case when initial_drop_pct > 0 then least(50, greatest(0.01::double, round(initial_drop_pct, 2))) when initial_drop_pct <= 0 then 0 end as drop_x, least(200, greatest(2, atr_period))::int as period, least(3600, greatest(5, atr_bar_seconds))::int as bar_s, avg_sell_price,
  case when avg_buy_price > 0 and coalesce(sell_trailing_stop_pct, 0) < 100 then round(round(avg_buy_price * (1 + greatest(0.01::double, rise_trigger_pct) / 100), 4) / (1 - greatest(0, coalesce(sell_trailing_stop_pct, 0)) / 100), 4) end as required from c),
g as (select *, (avg_sell_price / required - 1) * 10000 as gain from n) select id, drop_x, period, bar_s, required, gain as gain_bps, case when abs(gain) <= 1000 then greatest(0, -gain) end as adverse_bps from g""",
    "setting_grids": f"""with p as (select 'off' as m, 0.0::double as v union all select 'manual', unnest({_AXIS(1, 2, 3, 4, 5)}) union all select 'atr', unnest({_AXIS(1.5, 2, 2.5, 3, 3.5, 4, 4.5)})),
c as (select a, b, x, y, z from (select unnest({_AXIS(0.75, 1.5, 2.25)}) as a), (select unnest({_AXIS(0, 0.75, 1.25)}) as b), (select unnest({_AXIS(0.5, 1, 1.5)}) as x), (select unnest({_AXIS(0, 0.75, 1.25)}) as y), (select unnest({_AXIS(0.01, 0.05, 0.1, 0.2)}) as z)),
w as (select per, bar, t.* from (select unnest([5, 7, 10, 14, 21, 28]) as per), (select unnest([15, 30, 60, 120]) as bar), (values (1.5, 0.75, 1.0, 1.0), (1.0, 0.5, 0.75, 0.75), (2.0, 1.0, 1.25, 1.25), (2.0, 1.0, 1.0, 1.0), (1.5, 0.75, 0.75, 0.5)) as t(a, b, x, y)),
r as (select distinct greatest(0.25, a + i / 4) as a, greatest(0, b + j / 4) as b, greatest(0.25, x + k / 4) as x, greatest(0, y + l / 4) as y, z from c, range(-1, 2) as i(i), range(-1, 2) as j(j), range(-1, 2) as k(k), range(-1, 2) as l(l) where a = 0.75 and y = 0 and z = 0.01)
select 'policy' as grid, m || '/' || v as point from p union all select 'window', printf('%.2f/%.2f/%.2f/%.2f/%.2f/%.2f', per::double, bar::double, a::double, b::double, x::double, y::double) from w
union all select 'coarse', printf('%.2f/%.2f/%.2f/%.2f/%.2f', a, b, x, y, z) from c union all select 'refined', printf('%.2f/%.2f/%.2f/%.2f/%.2f', a::double, b::double, x::double, y::double, z) from r""",
    "recorded_sessions": f"""with {T} select session_id, count(*) as readings, count(*) filter (t0.sz) as bad_rows, sum(case when t0.sz then null else bid end) as bids, count(case when t0.sz then null else last end) as lasts,
  left(strftime(max(case when t0.sz then null else captured_at_utc end), '%Y-%m-%dT%H:%M:%S'), 19) as latest, 0 as problems from (select distinct on (session_id, tick_id) *, coalesce(bid_size < 0, false) or coalesce(ask_size < 0, false) or coalesce(last_size < 0, false) or coalesce(volume < 0, false) as sz from ticks where tick_id is not null) t0 group by 1""",
    "best_runs": f"""with {_CX}, {_R}, g as (select r.bot_id, round(initial_drop_pct * 2)::bigint as step, avg(value) as score from r join c using (id) where initial_drop_pct is not null group by 1, 2), b as (select *, max(score) over (partition by bot_id) as top from g),
n as (select *, step - row_number() over (partition by bot_id order by step) as run from b where score >= top - greatest(2, 0.1::double * abs(top))), k as (select bot_id, run, min(step) as first, max(step) as last, count(*) as steps, max(score) as best, min(score) as worst from n group by 1, 2)
select bot_id, first, last, steps, (first + last) // 2 as centre, best, worst from k""",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "buy_observations": ["seconds"],
    "observation_metrics": ["median_s", "probability"],
    "capture_matches": ["away_s"],
    "weighted_days": ["median", "mean"],
    "fill_samples": ["price"],
    "execution_model": ["age_p50", "slippage_p50", "slippage_p75"],
    "supported_costs": ["cost"],
    "order_slippage": ["slippage_bps", "quoted_pct"],
    "selection_stability": ["stability_pct"],
    "selection_bootstrap": ["mean_drawn", "mean_left_out"],
    "walk_forward_selection": ["train", "validate"],
    "paired_evidence": ["median", "lo95", "lo80", "hi80", "hi95", "positive"],
    "paired_leave_one_out": ["lowest", "middle", "highest"],
    "stressed_returns": ["score"],
    "after_exit_until_buy": ["lowest", "highest"],
    "leaf_checks": ["drop_x", "required", "gain_bps", "adverse_bps"],
    "best_runs": ["best", "worst"],
    "recorded_sessions": ["bids"],
}
