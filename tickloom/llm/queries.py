"""Queries of this subpackage over their whole tables, and SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import iso_micros, materialize, table
from . import bpe, leakage, nearest, percentiles, spans

#: Largest distance in time of a fill and its tick.
FILL_TOLERANCE_US = 15_000_000
#: Largest age of the quote against which slippage is measured.
QUOTE_AGE_US = 5_000_000
QUANTILES = [0.5, 0.75, 0.9]
#: Leading bits of the day histograms: values within one part in 2^20.
DAY_BITS = 32


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "executions").select(F.upper(F.trim("ticker")).alias("e"), F.col("id").alias("lid"), iso_micros(F.col("executed_at")).alias("t"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "ticks").where("bid is not null").select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), F.col("tick_id").alias("rid"))
    got = nearest.nearest(_fills(spark, d), ticks, FILL_TOLERANCE_US)
    return got.select(F.col("lid").alias("execution_id"), F.col("rid").alias("tick_id")).distinct()


def costs(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, side, day, metric, bps): commission and adverse slippage of every fill in basis points of its notional.

    A fill that comes twice counts once (largest commission). Slippage is measured against the latest sound quote
    of the fill's symbol, at most QUOTE_AGE_US old; fills without one, or without a notional above zero, have none.
    """
    x = table(spark, d, "executions").where("id is not null").groupBy("id").agg(
        F.max_by(F.struct(F.upper(F.trim("ticker")).alias("ticker"), "side", "shares", "price"), F.struct("executed_at", "ticker")).alias("f"), F.max("commission").alias("commission"), F.max(iso_micros(F.col("executed_at"))).alias("t")
    )
    x = materialize(x.select("id", "f.*", "commission", "t").withColumn("notional", F.col("shares") * F.col("price")).where("notional > 0 and side is not null and ticker is not null"))
    q = table(spark, d, "ticks").where("bid > 0 and ask >= bid").select(F.col("symbol").alias("e"), F.unix_micros("captured_at_utc").alias("t"), F.col("tick_id").alias("rid"), "bid", "ask")
    left = x.select(F.col("ticker").alias("e"), F.col("id").alias("lid"), "t")
    # Ticks of one instant: the smallest tick_id's quote counts.
    quotes = nearest.nearest(left, q, QUOTE_AGE_US, backward=True, payload=("bid", "ask")).select("lid", "bid", "ask")
    worse = F.when(F.col("side") == "BOT", F.col("price") / F.col("ask") - 1).when(F.col("side") == "SLD", F.col("bid") / F.col("price") - 1)
    j = x.join(quotes, x["id"] == quotes["lid"], "left").select("ticker", "side", F.to_date(F.timestamp_micros("t")).alias("day"), (F.col("commission") / F.col("notional") * 10000).alias("c"), (F.when(worse.isNotNull(), F.greatest(worse, F.lit(0.0))) * 10000).alias("s"))
    return j.select("ticker", "side", "day", F.explode(F.array(F.struct(F.lit("commission").alias("metric"), F.col("c").alias("bps")), F.struct(F.lit("slippage").alias("metric"), F.col("s").alias("bps")))).alias("_")).select("ticker", "side", "day", "_.*").where("bps is not null")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.exact_percentiles(costs(spark, d), ["ticker", "side", "metric"], "bps", QUANTILES)


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same from histograms of separate days put together, within one part in 2^20."""
    keys = ["ticker", "side", "metric"]
    c = costs(spark, d).withColumn("bits", percentiles.ordered_bits(F.col("bps").cast("double"))).where("bits is not null")
    days = materialize(percentiles.digit_histogram(c, [*keys, "day"], "bits", DAY_BITS))
    return percentiles.sketch_percentiles(percentiles.merge_histograms(days, keys), keys, QUANTILES, DAY_BITS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """All leaking pairs, also those with changed words: the equal windows of ten words, and the best similarity of an item-sized one."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    """Per post how many of its characters are shared."""
    return p10_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("shared_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p6_percentiles, p6_daily, p8_ids, p9_found, p9_near, p10_found, p10_share)}

_STAMP = "epoch_us(cast(case when regexp_matches(executed_at, '(Z|[+-]\\d\\d:?\\d\\d)$') then executed_at else executed_at || 'Z' end as timestamptz))"

SQL = {
    "p2_found": f"""with e as (select distinct id, upper(trim(ticker)) as symbol, {_STAMP} as t from executions where id is not null),
k as (select symbol, epoch_us(captured_at_utc) as t, min(tick_id) as tick_id from ticks where bid is not null and symbol is not null group by 1, 2),
b as (select e.*, k.t as kt, k.tick_id from e asof join k on e.symbol = k.symbol and e.t >= k.t),
a as (select e.*, k.t as kt, k.tick_id from e asof join k on e.symbol = k.symbol and e.t <= k.t),
u as (select * from b union all select * from a)
select distinct id as execution_id, tick_id from (select *, row_number() over (partition by id, symbol, t order by abs(kt - t), kt) as r from u where abs(kt - t) <= 15000000) where r = 1""",
    "p6_percentiles": f"""with x as (
  select id, max_by(struct_pack(ticker := upper(trim(ticker)), side := side, shares := shares, price := price), struct_pack(a := executed_at, b := ticker)) as f, max(commission) as commission, max({_STAMP}) as t from executions where id is not null group by id
), y as (select id, f.ticker as ticker, f.side as side, f.price as price, f.shares * f.price as notional, commission, t from x where f.shares * f.price > 0 and f.side is not null and f.ticker is not null),
q as (select symbol, epoch_us(captured_at_utc) as t, min_by(bid, tick_id) as bid, min_by(ask, tick_id) as ask from ticks where bid > 0 and ask >= bid group by 1, 2),
j as (select y.*, case when y.t - q.t <= 5000000 then q.bid end as bid, case when y.t - q.t <= 5000000 then q.ask end as ask from y asof left join q on y.ticker = q.symbol and y.t >= q.t),
m as (
  select ticker, side, 'commission' as metric, commission / notional * 10000 as bps from j
  union all select ticker, side, 'slippage', greatest(case side when 'BOT' then price / ask - 1 when 'SLD' then bid / price - 1 end, case when bid is not null then 0.0 end) * 10000 from j where bid is not null and side in ('BOT', 'SLD')
)
select ticker, side, metric, q.q as q, case q.q when 0.5 then quantile_cont(bps, 0.5) when 0.75 then quantile_cont(bps, 0.75) else quantile_cont(bps, 0.9) end as value
from m, (values (0.5::double), (0.75::double), (0.9::double)) as q(q) where bps is not null group by ticker, side, metric, q.q""",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "p6_percentiles": ["q", "value"],
}
