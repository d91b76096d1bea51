import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F
from tickloom.llm import percentiles as P

SCHEMA = "g string, h int, v double, q string, bits string, day int"


def test_bits_keep_order_and_come_back(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3] + [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(2000)]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "v double").withColumn("b", P.ordered_bits(F.col("v"))).withColumn("w", P.from_bits(F.col("b")))
    rows = df.collect()
    assert all(r.w == r.v for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.b)] == sorted(xs)
    assert spark.createDataFrame([(None,), (math.nan,)], "v double").select(P.ordered_bits(F.col("v")).alias("b")).distinct().collect() == [(None,)]


def data(n=3000):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([1, 2]), r.choice([None, math.nan, 7.25, 7.25, r.gauss(0, 1e3), r.random() * 1e-9, -r.random()]), "", "", i % 5) for i in range(n)]
    return rows + [("one", 1, 3.0, "", "", 0), ("none", 1, None, "", "", 0)]


def expected(rows, qs):
    out = {}
    for k in {(g, h) for g, h, *_ in rows}:
        v = sorted(x[2] for x in rows if (x[0], x[1]) == k and x[2] is not None and x[2] == x[2])
        if v:
            out |= {(*k, q): float(np.quantile(v, q)) for q in qs}
    return out


def test_exact_against_numpy(spark):
    rows, qs = data(), [0.0, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.h if r.h is None else int(r.h), r.q): r.value for r in P.exact_percentiles(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "v", qs).collect()}
    want = expected(rows, qs)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-300) for k in want)


def test_days_add_up_within_the_bound(spark):
    rows, qs, width = data(), [0.5, 0.9], 32
    df = spark.createDataFrame(rows, SCHEMA).withColumn("b", P.ordered_bits(F.col("v"))).where("b is not null")
    days = P.digit_histogram(df, ["g", "h", "day"], "b", width)
    whole = P.digit_histogram(df, ["g", "h"], "b", width)
    merged = P.merge_histograms(days, ["g", "h"])
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.collect()}
    want = expected([r for r in rows if r[0] is not None], qs)
    for r in P.sketch_percentiles(merged, ["g", "h"], qs, width).collect():
        w = want[r.g, r.h, r.q]
        assert abs(r.value - w) <= abs(w) * 2.0**-18 + 1e-12


def test_empty(spark):
    assert P.exact_percentiles(spark.createDataFrame([], SCHEMA), ["g"], "v", [0.5]).collect() == []
