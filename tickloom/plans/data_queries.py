"""Queries of the data-quality operators over their whole tables, and SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import intervals, regular_grid, rejects, schema_drift, spikes
from ..util import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(table(spark, d, "ticks")).select("tick_id", "field")


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings by rule and field."""
    return spikes.flag_readings(table(spark, d, "ticks")).groupBy("rule", "field").count().withColumnRenamed("count", "readings")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(table(spark, d, "cycle_exports"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unified_cycles(table(spark, d, "cycle_exports"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.capture_rejects(table(spark, d, "capture_lines")).select("line_id", "reason").distinct()


def p4_points(spark: SparkSession, d: str) -> DataFrame:
    return rejects.capture_points(table(spark, d, "capture_lines")).select("line_id", "price", "changed_fields").selectExpr("line_id", "price", "array_join(changed_fields, ',') as changed_fields")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_bars(spark, d).where("filled").select("session_id", "bar_start")


def p5_bars(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with imputed values."""
    return regular_grid.regular_bars(table(spark, d, "ticks"), table(spark, d, "sessions"), table(spark, d, "instruments"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.fragment_periods(table(spark, d, "fragments"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rules, p3_found, p3_unified, p4_found, p4_points, p5_found, p5_bars, p7_found)}

_NAMES = "|".join(rejects.CHANGED_FIELDS)
_P4 = rf"""
with l as (
  select line_id, coalesce(line_text, '') as t, regexp_replace(replace(coalesce(line_text, ''), chr(1), ' '), '"[^"]*"', chr(1), 'g') as k
  from capture_lines where line_no is distinct from 1
), q as (
  select *, contains(k, '"') or regexp_matches(k, '[^,' || chr(1) || ']' || chr(1) || '|' || chr(1) || '[^,' || chr(1) || ']', 's') as bad, len(k) - len(replace(k, ',', '')) + 1 as n from l
), f as (
  select *, list_transform(regexp_extract_all(',' || t, ',((?:"[^"]*")+|[^",]*)', 1, 's'), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as c from q
), v as (
  select *, c[2 - 1] as ts, c[7] as price, c[10] as ch from f
)
select line_id, ts, price, ch, bad, n,
  regexp_full_match(ts, '\d{{4}}-\d\d-\d\d[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{{1,6}})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?') and left(ts, 4) <> '0000' and try_cast(left(ts, 10) as date) is not null as ts_ok,
  coalesce(regexp_full_match(price, '\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') and try_cast(case when left(price, 1) = '+' then price[2:] else price end as double) > 0 and isfinite(try_cast(case when left(price, 1) = '+' then price[2:] else price end as double)), false) as price_ok,
  trim(ch) = '' or regexp_full_match(ch, ' *({_NAMES}) *(, *({_NAMES}) *)*') as ch_ok
from v"""

SQL = {
    "p4_found": f"""with x as ({_P4}) select distinct line_id, case when bad then 'quoting' when n <> 11 then 'column_count' when not ts_ok then 'captured_at_utc' when not price_ok then 'price' else 'changed_fields' end as reason
from x where bad or n <> 11 or not ts_ok or not price_ok or not ch_ok""",
    "p4_points": f"""with x as ({_P4}) select line_id, cast(case when left(price, 1) = '+' then price[2:] else price end as double) as price, array_to_string(list_filter(list_transform(string_split(ch, ','), lambda y: trim(y)), lambda y: y <> ''), ',') as changed_fields
from x where not bad and n = 11 and ts_ok and price_ok and ch_ok""",
    "p5_found": """with s as (
  select session_id, min(struct_pack(con_id := con_id, o := schedule_open_utc, c := schedule_close_utc)) as x from sessions where session_id is not null group by 1
), g as (
  select session_id, i.bar, epoch_us(x.o) // (i.bar * 1000000) * i.bar as first, epoch_us(x.c) as close_us
  from s join (select con_id, max(atr_bar_seconds)::bigint as bar from instruments group by 1) i on i.con_id = x.con_id where x.c > x.o and i.bar >= 1
), bars as (select session_id, bar, unnest(range(first, (close_us - 1) // 1000000 + 1, bar)) as bar_start from g),
seen as (select distinct t.session_id, epoch_us(t.captured_at_utc) // (g.bar * 1000000) * g.bar as bar_start from ticks t join g using (session_id) where t.last is not null and isfinite(t.last))
select session_id, bar_start from bars anti join seen using (session_id, bar_start)""",
    "p7_found": """with f as (
  select distinct con_id, replace(trim(session_date), '-', '') as session_date, round(observed_start_timestamp * 1000)::bigint as s, round(observed_end_timestamp * 1000)::bigint as e
  from fragments where observed_start_timestamp <= observed_end_timestamp
), m as (select *, max(e) over (partition by con_id, session_date order by s, e rows between unbounded preceding and 1 preceding) as before from f where s <= e),
g as (select *, sum(case when s <= before then 0 else 1 end) over (partition by con_id, session_date order by s, e rows unbounded preceding) as island from m),
p as (select con_id, session_date, min(s) as s, max(e) as e from g group by con_id, session_date, island),
n as (select *, lead(s) over (partition by con_id, session_date order by s) as after from p)
select con_id, session_date, 'period' as kind, s as start_ms, e as end_ms from n
union all select con_id, session_date, 'gap', e, after from n where after is not null""",
}

#: Computed numbers, rounded to six places on both sides of a comparison: sums depend on their order in the last bits.
ROUNDED: dict[str, list[str]] = {
    "p4_points": ["price"],
}
