import random

from pyspark.sql import functions as F
from tickloom.operators.intervals import fragment_periods, periods_and_gaps

SCHEMA = "k string, s long, e long, start_ms string"


def brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        iv = sorted((s, e) for kk, s, e, _ in rows if kk == k and s is not None and e is not None and s <= e)
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in periods_and_gaps(df, ["k"], F.col("s"), F.col("e")).collect()]


def test_against_brute_force_with_ties_nulls_and_a_clashing_column(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), s := r.randrange(0, 40_000_000), s + r.choice([0, 1, 1000, r.randrange(0, 3_000_000), -5]), "x") for _ in range(600)]
    rows += rows[:50] + [("a", None, 5, "x"), ("a", 5, None, "x"), (None, 1, 2, "x")]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_touching_neighbouring_and_empty_length(spark):
    rows = [("a", 0, 10, ""), ("a", 10, 20, ""), ("a", 21, 21, ""), ("a", 21, 21, ""), ("b", 3_600_000 - 1, 3_600_000 + 5, ""), ("b", 3_600_000, 3_600_001, "")]
    assert set(run(spark, rows)) == {("a", "period", 0, 20), ("a", "gap", 20, 21), ("a", "period", 21, 21), ("b", "period", 3_599_999, 3_600_005)}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_fragment_dates_in_two_spellings(spark):
    f = spark.createDataFrame([(1, "20260105", 1.0, 2.0), (1, "2026-01-05", 1.5, 3.0), (1, "20260105", None, 9.0), (1, "20260105", float("nan"), 9.0)], "con_id long, session_date string, observed_start_timestamp double, observed_end_timestamp double")
    assert [tuple(r) for r in fragment_periods(f).collect()] == [(1, "20260105", "period", 1000, 3000)]
