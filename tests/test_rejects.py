import csv
import io
import random

from tickloom.operators.rejects import capture_points, capture_rejects

SCHEMA = "line_id long, file_name string, line_no int, line_text string, reason string"
GOOD = "2026-01-07T15:16:30.457Z,1000.000,RISJ,cy1,50,DONE,9.2242,mark,,volume,ok"


def run(spark, lines):
    df = spark.createDataFrame([(i, "f", i + 2, t, "x") for i, t in enumerate(lines)], SCHEMA)
    got = {r.line_id: r.reason for r in capture_rejects(df).collect()}
    loaded = {r.line_id for r in capture_points(df).collect()}
    assert not loaded & set(got) and len(loaded) + len(got) == len(lines)
    return got


def line(**k):
    f = {"ts": "2026-01-07T15:16:30Z", "price": "1.5", "ch": "bid", "note": "n"} | k
    return f"{f['ts']},1,T,c,5,S,{f['price']},mark,,{f['ch']},{f['note']}"


def test_reasons_in_order(spark):
    cases = {
        GOOD: None,
        line(note='"two\nlines"'): None,
        line(note='"a ""b"" c"'): None,
        line(ch='"bid, ask"'): None,
        line(ch=""): None,
        line(price="+1.5e1"): None,
        line(price="36."): None,
        line(price='"2"'): None,
        line(ts="2026-01-07 15:16:30.123456-05:00"): None,
        line(note='"open'): "quoting",
        line(note='a"b"'): "quoting",
        line(note='"a"b'): "quoting",
        line(note='"a" "b"'): "quoting",
        "a,b": "column_count",
        "": "column_count",
        GOOD + ",": "column_count",
        line(ts="2026-02-30T00:00:00Z"): "captured_at_utc",
        line(ts="2026-01-07T24:00:00Z"): "captured_at_utc",
        line(ts="2026-01-07T15:16:30.1234567Z"): "captured_at_utc",
        line(ts="", price="x"): "captured_at_utc",
        line(price="0"): "price",
        line(price="NaN"): "price",
        line(price="1e999"): "price",
        line(price="-1"): "price",
        line(price=" 1"): "price",
        line(price="1e-999"): "price",
        line(ch="bids"): "changed_fields",
        line(ch='"bid,,ask"'): "changed_fields",
        line(ch='"bid,"'): "changed_fields",
    }
    got = run(spark, list(cases))
    assert {t: got.get(i) for i, t in enumerate(cases)} == cases


def test_quoting_against_a_state_machine(spark):
    def sound(t):
        i, n = 0, len(t)
        while True:
            if i < n and t[i] == '"':
                i += 1
                while True:
                    if i >= n:
                        return False
                    if t[i] == '"':
                        if i + 1 < n and t[i + 1] == '"':
                            i += 2
                            continue
                        i += 1
                        break
                    i += 1
                if i < n and t[i] != ",":
                    return False
            else:
                while i < n and t[i] != ",":
                    if t[i] == '"':
                        return False
                    i += 1
            if i >= n:
                return True
            i += 1

    r = random.Random(3)
    lines = ["".join(r.choice('"",,a\n\u0001') for _ in range(r.randrange(0, 14))) for _ in range(800)]
    got = run(spark, lines)
    assert all((got[i] == "quoting") == (not sound(t)) for i, t in enumerate(lines))
    for t in (x for x in lines if sound(x) and "\n" not in x and x):
        assert len(next(csv.reader(io.StringIO(t), strict=True))) >= 1


def test_long_null_repeated_and_header_lines(spark):
    long = line(note='"' + '""' * 200_000 + '"')
    df = spark.createDataFrame([(1, "f", 1, "header", ""), (2, "f", 2, long, ""), (3, "f", 3, None, ""), (None, None, None, "bad", ""), (None, None, None, GOOD, ""), (4, "f", 4, "x", ""), (4, "f", 4, "x", "")], SCHEMA)
    assert sorted((r.line_id or 0, r.reason) for r in capture_rejects(df).collect()) == [(0, "column_count"), (3, "column_count"), (4, "column_count"), (4, "column_count")]
    pts = {r.line_id: r for r in capture_points(df).collect()}
    assert set(pts) == {2, None} and pts[2].note == '"' * 200_000 and pts[2].changed_fields == ["bid"]


def test_empty_table(spark):
    assert run(spark, []) == {}
