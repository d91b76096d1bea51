import itertools
import json
import random
from datetime import datetime, timezone

from tickloom.operators.schema_drift import best_matching, drift_report, unified_cycles

SCHEMA = "export_id long, bot_id long, exported_at timestamp, row_json string, kind string"


def files(spark, *versions, bot=1):
    rows = [(i, bot, datetime(2026, 1, 1, i, tzinfo=timezone.utc), r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, v in enumerate(versions) for r in v]
    return spark.createDataFrame(rows, SCHEMA)


def report(df):
    rows = [tuple(r) for r in drift_report(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rename_retype_add_remove(spark):
    a = [{"id": f"c{i}", "p": i + 0.5, "at": f"2026-01-0{i + 1}T00:00:00.000Z", "flag": i % 2, "gone": f"x{i}", "n": None} for i in range(6)]
    b = [{"id": r["id"], "price": f"{r['p']}", "at": 1767225600000 + 86400000 * i, "flag": bool(r["flag"]), "fresh": f"y{i}", "n": 1} for i, r in enumerate(a)]
    assert report(files(spark, a, b + b[:2] + ["[1]", "broken", None])) == {
        (1, "renamed", "price", "p"), (1, "retyped", "price", ""), (1, "retyped", "at", ""), (1, "retyped", "flag", ""), (1, "removed", "gone", ""), (1, "added", "fresh", ""),
    }


def test_notation_of_a_renamed_field_and_swapped_values(spark):
    a = [{"id": f"c{i}", "drop_pct": 1.25 + i, "x": i, "y": 100 - i} for i in range(8)]
    b = [{"id": r["id"], "dropPct": f"{r['drop_pct']}%", "u": r["y"], "v": r["x"]} for r in a]
    got = report(files(spark, a, b))
    assert {(1, "renamed", "dropPct", "drop_pct"), (1, "renamed", "u", "y"), (1, "renamed", "v", "x"), (1, "retyped", "dropPct", "")} == got


def test_chance_agreement_of_flags_is_no_rename(spark):
    a = [{"id": f"c{i}", "enabled": 1} for i in range(6)]
    b = [{"id": f"c{i}", "is_simulated": 1} for i in range(6)]
    assert report(files(spark, a, b)) == {(1, "removed", "enabled", ""), (1, "added", "is_simulated", "")}


def test_no_shared_records_empty_and_first_files(spark):
    assert report(files(spark, [{"id": "a", "p": 1}], [{"id": "b", "q": 1}])) == {(1, "removed", "p", ""), (1, "added", "q", "")}
    assert report(files(spark, [{"id": "a", "p": 1}])) == set()
    assert report(files(spark)) == set()


def test_profiles_find_a_rename_without_shared_records(spark):
    a = [{"id": f"a{i}", "initial_drop": i + 0.5, "stage": f"s{i % 2}", "old": f"o{i}"} for i in range(8)]
    b = [{"id": f"b{i}", "initial_drop_pct": f"{i + 0.5}", "fresh": f"n{i}", "mood": f"s{i % 2}"} for i in range(8)]
    assert report(files(spark, a, b)) == {
        (1, "renamed", "initial_drop_pct", "initial_drop"), (1, "retyped", "initial_drop_pct", ""), (1, "removed", "old", ""), (1, "added", "fresh", ""),
        (1, "removed", "stage", ""), (1, "added", "mood", ""),  # two values under different names are too little
    }


def test_two_spellings_beside_each_other_stay_two_columns(spark):
    a = [{"id": f"a{i}", "drop": i + 0.5} for i in range(6)]
    df = files(spark, a, [{"id": r["id"], "drop_pct": r["drop"]} for r in a]).unionByName(files(spark, [], [], [{"id": "b", "drop": 1.5, "drop_pct": 5.5}], bot=2))
    rows = {(r.export_id, r.id): r for r in unified_cycles(df).collect()}
    assert (rows[2, "b"].drop, rows[2, "b"].drop_pct) == ("1.5", "5.5")
    assert all(rows[f, f"a{i}"].drop == str(i + 0.5) and rows[f, f"a{i}"].drop_pct is None for f in (0, 1) for i in range(6))


def test_unified_table_follows_renames(spark):
    a = [{"id": f"c{i}", "p": i + 0.5} for i in range(5)]
    b = [{"id": f"c{i}", "price": f"{i + 0.5}"} for i in range(5)]
    rows = unified_cycles(files(spark, a, b)).collect()
    assert len(rows) == 10 and {(r.export_id, r.id, r.p) for r in rows} == {(f, f"c{i}", str(i + 0.5)) for f in (0, 1) for i in range(5)}


def test_unified_values_stay_as_they_are_and_get_one_type(spark):
    a = [{"id": f"c{i}", "ticker": f"AbC{i}", "code": f"00{i}", "pct": i + 0.25, "at": f"2026-01-0{i + 1}T00:00:00.000Z", "on": i % 2, "qty": 10**16 + i} for i in range(5)]
    b = [r | {"ticker": f"aBc{i}", "pct": f"{i + 0.25}%", "at": 1767225600000 + 86400000 * i, "on": bool(r["on"])} for i, r in enumerate(a)]
    df = unified_cycles(files(spark, a, b))
    rows = {(r.export_id, r.id): r for r in df.collect()}
    for i in range(5):
        x, y = rows[0, f"c{i}"], rows[1, f"c{i}"]
        assert (x.ticker, y.ticker, x.code, y.pct, x.qty) == (f"AbC{i}", f"aBc{i}", f"00{i}", f"{i + 0.25}%", str(10**16 + i))
        assert (x.typed.ticker, x.typed.code, x.typed.qty) == (f"AbC{i}", f"00{i}", 10**16 + i)
        assert x.typed.pct == y.typed.pct == i + 0.25 and x.typed.at == y.typed.at and x.typed.on is y.typed.on is bool(i % 2)
    assert {f.name: f.dataType.simpleString() for f in df.schema["typed"].dataType} == {"ticker": "string", "code": "string", "pct": "double", "at": "timestamp", "on": "boolean", "qty": "bigint"}


def test_matching_is_optimal():
    r = random.Random(2)
    for _ in range(200):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        w = [[r.choice([0.0, r.random()]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in best_matching(w))
        k = min(n, m)
        best = max(sum(w[i][j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9
