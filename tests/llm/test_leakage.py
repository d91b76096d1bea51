import random
from collections import Counter

import numpy as np
from tickloom.llm import leakage
from tickloom.llm.leakage import Index, MultiIndex, fingerprint, leaks, radius, similarity, word_hashes, words

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id string, passage string, text string"


def exact_pairs(docs, items):
    out = set()
    for d, t, _ in docs:
        w = words(t)
        have = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for name, p, _ in items:
            v = words(p)
            if d is not None and name is not None and any(tuple(v[i : i + 10]) in have for i in range(len(v) - 9)):
                out.add((d, name))
    return out


def shingle_similarity(a, b):
    """Written apart from the operator: counts of runs of five words."""
    x, y = (Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4)) for v in (a, b))
    return (x & y).total() / (x | y).total()


def near_pairs(docs, items):
    out = {}
    for d, t, _ in docs:
        w = words(t)
        for name, p, _ in items:
            v = words(p)
            n = min(len(v), len(w))
            if d is not None and name is not None and len(v) >= 10 and n >= 5:
                if not {*w} & {*v}:
                    continue
                best = max(shingle_similarity(w[i : i + n], v) for i in range(len(w) - n + 1))
                if best >= leakage.NEAR - 1e-12:
                    out[d, name] = round(best, 9)
    return out


def run(spark, docs, items):
    rows = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    assert all(r.exact == (r.parts > 0) and (r.exact or r.similarity is not None) for r in rows)
    return rows


def make(seed, n_docs=80, n_items=30):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "x2"]
    item = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(f"i{k}", item(r.randrange(5, 60)), "") for k in range(n_items)]
    items += [("same", items[0][1], ""), items[1], (None, item(20), ""), ("null", None, ""), ("empty", "", "")]
    docs = []
    for d in range(n_docs):
        w = item(r.randrange(0, 80)).split()
        if r.random() < 0.6:
            v = words(r.choice(items[:n_items])[1])
            a = r.randrange(0, max(1, len(v) - 8))
            part = v[a : a + r.randrange(8, 14)]
            part = [x.upper() if r.random() < 0.3 else x for x in part]
            at = r.randrange(0, len(w) + 1)
            w[at:at] = [p if r.random() < 0.9 else f"{p}<b class=q> &amp;[i]" for p in part]
        docs.append((d, " ,".join(w).replace("w1", "w­1"), "z"))
    return docs + [(900, None, ""), (901, "", ""), (None, items[0][1], ""), docs[0]], items


def changed(seed, n_docs=150, n_items=30):
    """Documents that hold whole passages in which words were changed, left out or put in, or the passage was cut."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    items = [(f"i{k}", " ".join(r.choice(vocab) for _ in range(r.randrange(10, 140))), "") for k in range(n_items)]
    items.append(("turns", " ".join((["go", "on", "and"] * 20)[:50]), ""))
    docs = []
    for d in range(n_docs):
        v = r.choice(items)[1].split()
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            k = r.choice([0, 1, len(v) - 1, r.randrange(len(v)), r.randrange(len(v))])
            v[k : k + r.choice([0, 1, 1])] = [f"x{d}"] * r.choice([0, 1, 1])
        around = [r.choice(vocab) for _ in range(r.choice([0, 0, 30]))]
        docs.append((d, " ".join(around + v[r.choice([0, 0, 3]) :] + around[::-1]), ""))
    return docs, items


def test_against_brute_force(spark):
    docs, items = make(1)
    got, want = run(spark, docs, items), exact_pairs(docs, items)
    assert {(r.doc_id, r.item_id) for r in got if r.exact} == want and len(want) > 20
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got if r.similarity is not None} == near_pairs(docs, items)


def test_passages_with_changed_words_are_recalled(spark):
    """All pairs of similarity 0.8 or more but those whose fingerprints lie beyond the radius: at least 99 of 100."""
    found, true, only_near = 0, 0, 0
    for seed in (4, 5):
        docs, items = changed(seed)
        want = near_pairs(docs, items)
        rows = run(spark, docs, items)
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows if r.similarity is not None}
        assert got.items() <= want.items()
        assert {(r.doc_id, r.item_id) for r in rows if r.exact} == exact_pairs(docs, items)
        found, true, only_near = found + len(got), true + len(want), only_near + sum(x < 1 for x in want.values())
    assert true > 150 and only_near > 100 and found >= 0.99 * true


def test_blocks_of_items_and_slabs_of_long_texts(spark, monkeypatch):
    docs, items = make(2)
    docs.append((950, " ".join(t for _, t, _ in docs if t) * 3, ""))
    want, near = exact_pairs(docs, items), near_pairs(docs, items)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    got = run(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in got if r.exact} == want
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got if r.similarity is not None} == near
    ix = Index([word_hashes(words(p)) for _, p, _ in items if p])
    text = word_hashes(words(docs[-1][1]))

    def scan():
        total = {}
        for _, passage, parts, best in leakage._scan([text], ix):
            for p, n, s in zip(passage.tolist(), parts.tolist(), best.tolist()):
                total[p] = (total.get(p, (0, 0))[0] + n, max(total.get(p, (0, 0))[1], s))
        return total

    once = scan()
    monkeypatch.setattr(leakage, "SLAB", 50)
    assert scan() == once and len(once) > 10


def test_every_fingerprint_within_the_radius_is_a_candidate():
    r = np.random.default_rng(1)
    ix = MultiIndex(r.integers(0, 2**63, 3000, dtype="uint64"))
    fp = ix.fp[r.integers(0, len(ix.fp), 300)].copy()
    most = r.integers(0, 20, len(fp))
    for i in range(len(fp)):
        for b in r.choice(64, min(19, most[i]), replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*(x.tolist() for x in ix.within(fp, most))))
    want = {(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ ix.fp) <= most[i])}
    assert got == want and len(want) >= 300


def test_the_radius_holds_the_distance_of_similar_windows():
    r = np.random.default_rng(2)
    for size in (13, 30, 60, 120):
        far = 0
        for _ in range(300):
            a = r.integers(0, 2**63, size, dtype="uint64")
            b = a.copy()
            if size < 49:  # a change inside would take more shingles than similarity 0.8 leaves
                b = np.r_[b[leakage.unshared(size - 4) :], r.integers(0, 2**63, leakage.unshared(size - 4), dtype="uint64")]
            else:
                b[r.integers(5, size - 5)] = 7
            assert similarity(a, b) >= leakage.NEAR
            far += (fingerprint(a) ^ fingerprint(b)).bit_count() > radius(size - 4)
        assert far <= 3
    assert radius(6) == 0


def test_words_and_similarity():
    assert words("A&nbsp;b<br/>c [quote=x]D​e_f-g 1.5") == ["a", "b", "c", "de", "f", "g", "1", "5"]
    a = np.arange(10, dtype="uint64")
    assert similarity(a, a) == 1 and similarity(a, np.r_[a[:9], np.uint64(77)]) == 5 / 7
    t = "a b a b a b a b a b a c".split()
    assert abs(similarity(word_hashes(t), word_hashes(t[2:])) - shingle_similarity(t, t[2:])) < 1e-12


def test_empty_tables(spark):
    docs, items = make(3, 3, 3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
