import base64
import os
import random

import pytest
from tickloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", "a", " ", "Hello, world!", "it's 2026  \n\n\t x", "naïve Ünïcödé 漢字 😀😀", "<|endoftext|>", "a" * 3000, "漢" * 2000, " " * 500, "ab" * 1500, "\x00\x01­​", "é" * 40, "'S 'll'"]


def test_same_ids_as_the_reference(reference):
    a = bpe.load()
    r = random.Random(8)
    alphabet = "aabbccddee  \n\tTHEthe'’éß漢字😀1290-_=<|>.,​­"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 80))) for _ in range(2000)]
    for t in texts:
        ids = a.encode(t)
        assert ids == reference(t), t
        assert a.decode(ids) == t


def test_arcs_are_the_proper_tokenizations_of_a_small_vocabulary():
    # Merges: a+a -> 2, a+b -> 3, aa+ab -> 4; every word over {a, b} against merging step by step.
    merges = [(0, 0, 2), (0, 1, 3), (2, 3, 4)]
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aaab"}
    a = bpe.Automaton(labels, merges)

    def plain(w):
        ids = [0 if c == "a" else 1 for c in w]
        for u, v, n in merges:
            out, i = [], 0
            while i < len(ids):
                if ids[i : i + 2] == [u, v]:
                    out.append(n)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    for n in range(1, 13):
        for k in range(1 << n):
            w = "".join("ab"[k >> i & 1] for i in range(n))
            assert a.encode_word(w.encode()) == plain(w), w


def test_a_full_transition_table_begins_anew(monkeypatch):
    a = bpe.load()
    want = [a.encode_word(w) for w in (b"tokenization", b"automaton", b"tokenize")]
    monkeypatch.setattr(bpe, "STATES", 5)
    assert [a.encode_word(w) for w in (b"tokenization", b"automaton", b"tokenize")] == want


def test_documents(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS])] + [(None, "null id", "x"), (3, "repeated", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode_documents(df)
    got = sorted(((r.doc_id, r.ids) for r in enc.collect()), key=str)
    assert got == sorted(((i, reference(t) if t else []) for i, t, _ in rows), key=str)
    back = {r.doc_id: r.text for r in bpe.decode_documents(enc.where("doc_id > 3")).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows if i is not None and i > 3)
    assert bpe.encode_documents(df.limit(0)).collect() == []
