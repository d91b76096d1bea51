import random

import pytest
from tickloom.llm import nearest as module
from tickloom.llm.nearest import nearest

L, R = "e string, lid string, t long, rid string", "e string, rid long, t long, lid string"


def brute(left, right, tol, backward):
    out = set()
    for e, lid, t, _ in left:
        if None in (e, lid, t):
            continue
        best = min(((abs(rt - t), rt, rid) for re_, rid, rt, _ in right if re_ == e and rt is not None and rid is not None and (not backward or rt <= t)), default=None)
        if best and best[0] <= tol:
            out.add((lid, t, best[2], best[1]))
    return out


@pytest.mark.parametrize(("parts", "block"), [(1, 500_000), (3, 60), (37, 500_000), (70, 7)])
@pytest.mark.parametrize("backward", [False, True])
def test_against_brute_force(spark, monkeypatch, parts, block, backward):
    """Also with blocks of a few rows, and more partitions than one chunk of the prefix scan holds."""
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "_CHUNK_BITS", 2)
    if block == 60:
        monkeypatch.setattr("tickloom.util.BROADCAST_BYTES", -1)
    r = random.Random(parts)
    names = ["hot", "hot", "hot", "a", "b", "only-left", None]
    left = [(r.choice(names), f"l{i}", r.randrange(0, 3000), "x") for i in range(400)] + [("hot", None, 5, ""), ("hot", "lx", None, "")]
    right = [(r.choice(["hot", "hot", "hot", "a", "b", "only-right", None]), r.randrange(0, 300), r.randrange(0, 3000), "x") for _ in range(500)] + [("hot", None, 5, ""), ("a", 3, None, "")]
    left, right = left + left[:30], right + right[:30]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), 40, backward).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got)) and set(got) == brute(left, right, 40, backward)


def test_one_instant_over_many_partitions(spark):
    right = [("a", i, 100, "") for i in range(2000, 0, -1)]
    left = [("a", f"l{i}", 100 + i % 3, "") for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    got = {tuple(x)[2] for x in nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), 5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {1}


def test_payload_comes_from_the_same_record(spark):
    right = spark.createDataFrame([("a", i, 10 * (i // 2), float(i), None if i % 3 else 2.0 * i) for i in range(200)], "e string, rid long, t long, bid double, ask double")
    left = spark.createDataFrame([("a", f"l{i}", i, "") for i in range(0, 990, 7)], L)
    rows = nearest(left, right, 100, payload=("bid", "ask")).collect()
    assert len(rows) == 142 and all(r.bid == r.rid and r.ask == (None if r.rid % 3 else 2.0 * r.rid) and r.rid % 2 == 0 for r in rows)


def test_empty_sides_and_tolerance_border(spark):
    row, other = [("a", "l", 10, "")], [("a", 1, 15, ""), ("a", 2, 4, "")]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    assert nearest(df([], L), df(other, R), 9).collect() == [] and nearest(df(row, L), df([], R), 9).collect() == []
    assert [tuple(x) for x in nearest(df(row, L), df(other, R), 5).collect()] == [("l", 10, 1, 15)]
    assert nearest(df(row, L), df(other, R), 4).collect() == []
