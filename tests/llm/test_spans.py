import random

import numpy as np
import pytest
from tickloom.llm import spans
from tickloom.llm.spans import LENGTH, compact_windows, shared_spans

SCHEMA = "doc_id long, text string, s int"


def brute(docs):
    seen = {}
    for d, t, _ in docs:
        for k in range(len(t or "") - LENGTH + 1):
            if d is not None:
                seen.setdefault(t[k : k + LENGTH], set()).add(d)
    out = set()
    for d, t, _ in docs:
        if d is None or t is None:
            continue
        on = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - LENGTH + 1):
            if len(seen[t[k : k + LENGTH]]) > 1:
                on[k : k + LENGTH] = True
        edge = np.flatnonzero(np.diff(np.r_[False, on].astype(int)))
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def run(spark, docs):
    got = [tuple(r) for r in shared_spans(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed, n=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh é漢😀") for _ in range(k))
    pool = [text(r.randrange(95, 400)) for _ in range(8)] + ["z" * 300, "xy" * 200]
    docs = []
    for d in range(n):
        parts = [text(r.randrange(0, 150))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(pool)
            a = r.randrange(0, len(p) // 2)
            parts += [p[a : a + r.randrange(60, 300)], text(r.randrange(0, 3))]
        docs.append((d, "".join(parts), 0))
    spam = text(700)
    docs += [(500 + i, spam, 0) for i in range(12)] + [(600, spam + "!", 0), (601, "?" + spam, 0), (602, spam[:350] + "#" + spam[350:], 0)]
    own = text(150)
    return docs + [(700, own + "1" + own, 0), (701, None, 0), (702, "", 0), (703, "a" * 5, 0), (None, spam, 0), docs[3], docs[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = make(seed)
    want = brute(docs)
    assert run(spark, docs) == want and len(want) > 30


def test_long_texts_in_chunks(spark, monkeypatch):
    r = random.Random(4)
    a = "".join(r.choice("abcdef") for _ in range(5000))
    docs = [(1, a, 0), (2, "-" + a[700:2600] + "+" + a[3000:3099] + "|" + a[4000:4100], 0)]
    want = brute(docs)
    assert run(spark, docs) == want
    text_windows = []
    monkeypatch.setattr(spans, "CHUNK", 777)
    for codes, _, base, first, n in spans._groups([a], 1000):
        t, s0, s1, *_ = compact_windows(codes, first, n)
        text_windows += [(int(x), int(y)) for x, y in zip(s0 + (base - first)[t], s1 + (base - first)[t])]
    assert text_windows[0][0] == 0 and text_windows[-1][1] == len(a) - LENGTH and all(y + 1 == x for (_, y), (x, _) in zip(text_windows, text_windows[1:]))


def test_windows_are_nodes_of_the_cartesian_tree():
    r = random.Random(6)
    for _ in range(30):
        codes = np.array([r.choice([97, 97, 98]) for _ in range(r.randrange(LENGTH, 400))], "uint32")
        _, s0, s1, c, *_ = compact_windows(codes)
        at = np.arange(len(codes) - spans.GRAM + 1)
        key = (spans.Prefix(codes).of(at, at + spans.GRAM) >> np.uint64(24)).tolist()
        found = set()

        def tree(lo, hi):
            while hi - lo >= spans._STARTS:
                m = min(range(lo, hi), key=lambda i: (key[i], i))
                a, b = max(lo, m - spans._STARTS + 1), min(m, hi - spans._STARTS)
                if a <= b:
                    found.add((a, b, m))
                tree(lo, m)
                lo = m + 1

        tree(0, len(key))
        assert set(zip(s0.tolist(), s1.tolist(), c.tolist())) == found


def test_pieces_have_one_set_of_smallest_grams():
    r = random.Random(8)
    codes = np.array([r.randrange(97, 100) for _ in range(700)], "uint32")
    _, s0, s1, *_ = compact_windows(codes)
    row, p0, p1, joint, *_ = spans.joint_pieces(codes, s0, s1)
    assert (np.sort(np.concatenate([np.arange(a, b + 1) for a, b in zip(p0, p1)])) == np.arange(len(codes) - LENGTH + 1)).all()
    assert (p0 >= s0[row]).all() and (p1 <= s1[row]).all() and len(row) > len(s0)
    for a, b, j in zip(p0, p1, joint):
        for s in range(a, b + 1):  # the signature of a stretch depends on its own characters alone
            *_, alone, _, _ = spans.joint_pieces(codes[s : s + LENGTH], np.array([0]), np.array([0]))
            assert alone.tolist() == [j]


def test_joins_of_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tickloom.util.BROADCAST_BYTES", -1)
    docs = make(9)
    assert run(spark, docs) == brute(docs)


def test_empty(spark):
    assert run(spark, []) == set()
