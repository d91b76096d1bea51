"""Long spans of text that stand verbatim in more than one record.

Tokens are the grams of GRAM characters; three hash functions order them. Under the first, every text is cut into
compact windows: each is the set of all stretches of LENGTH characters that share their smallest gram - a node of the
Cartesian tree over the hashes, as far as it holds stretches of that length. Windows are grouped by signature without
making pairs: equal windows fall into one class, which is shared if more than one record holds it. Where classes
differ under one signature, the windows of the other hash functions are joined to theirs by overlap of their intervals
of starts: a piece between two borders has one joint signature, the smallest grams under all functions and how far
they lie apart. Two equal stretches have equal joint signatures, so none is missed. Where different records share one,
the stretches are verified, each by a hash of its LENGTH characters within its joint signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, ship, small

#: Characters of the shortest shared span.
LENGTH = 100
#: Characters of a gram. Longer grams make fewer chance signatures, shorter ones fewer windows.
GRAM = 50
#: Characters hashed at once; longer texts are cut with overlap, so their spans stay whole.
CHUNK = 1 << 20
#: Multipliers that make the second and third hash function out of the first.
ORDERS = (0xD1342543DE82EF95, 0xDA942042E4DD58B5)

_STARTS = LENGTH - GRAM + 1  # grams of a stretch
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's constants
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 4096), b, "uint64")
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any stretches of one text: sums of mixed characters times powers of an odd base."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = _power(n + 1)
        self.sum = np.zeros(n + 1, "uint64")
        np.cumsum(_mix(codes.astype("uint64") * np.uint64(2) + np.uint64(1)) * up[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[start]) * self.down[start])

    def grams(self) -> np.ndarray:
        n = len(self.sum) - GRAM
        return _mix((self.sum[GRAM:] - self.sum[:n]) * self.down[:n])


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its smallest, of ties the leftmost."""
    n = len(h) - width + 1
    # The value's leading 40 bits and the position in one number: one sliding minimum gives both.
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype="uint64")
    pad = -len(key) % width
    full = np.r_[key, np.full(pad, np.iinfo("uint64").max)].reshape(-1, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype("int64")


def compact_windows(codes: np.ndarray, first: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, signature, content hash) of each compact window of texts that stand one
    after the other, each from ``first`` on with ``n`` characters; of one text, if these are not given."""
    first = np.zeros(1, "int64") if first is None else first
    starts = np.maximum((np.array([len(codes)]) if n is None else n) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(first)), starts)
    if not len(text):
        none = np.zeros(0, "int64")
        return none, none, none, none, none.view("uint64"), none.view("uint64")
    h = Prefix(codes)
    gram = h.grams()
    # Stretches across the border of two texts are left out; those inside a text hold its own grams alone.
    start = np.arange(len(text)) + np.repeat(first - np.cumsum(starts) + starts, starts)
    centre = smallest(gram, _STARTS)[start]
    cut = np.flatnonzero(np.r_[True, (centre[1:] != centre[:-1]) | (text[1:] != text[:-1])])
    s0, s1 = start[cut], start[np.r_[cut[1:], len(text)] - 1]
    c = centre[cut]
    return text[cut], s0, s1, c, gram[c], h.of(s0, s1 + LENGTH)


def joint_pieces(codes: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, first start, last start, joint signature, content hash) of the pieces into which the windows of the other
    hash functions cut the given windows of the first; and the hash of every stretch of the text."""
    h = Prefix(codes)
    gram = h.grams()
    first = smallest(gram, _STARTS)
    joint = gram[first]
    border = np.zeros(len(first), bool)
    for k in ORDERS:
        centre = smallest(_mix(gram * np.uint64(k)), _STARTS)
        border[1:] |= centre[1:] != centre[:-1]
        # The anchors' distance belongs to the signature.
        joint = _mix(joint + _mix(gram[centre] + (centre - first).astype("uint64") * np.uint64(_BASE)))
    # Interval join: a window goes from border to border.
    cuts = np.flatnonzero(border)
    lo, hi = np.searchsorted(cuts, s0, side="right"), np.searchsorted(cuts, s1, side="right")
    n = hi - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    edge = np.r_[cuts, 0]
    at = edge[np.minimum(lo[row] + k - 1, len(cuts))] if len(cuts) else np.zeros(len(row), "int64")
    p0 = np.where(k == 0, s0[row], at)
    p1 = np.where(k == n[row] - 1, s1[row], np.r_[p0[1:], 0] - 1)
    starts = np.arange(len(codes) - LENGTH + 1)
    return row, p0, p1, joint[p0], h.of(p0, p1 + LENGTH), h.of(starts, starts + LENGTH)


def _groups(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, row, base, first, n) of groups of texts that are handled together: each text, or chunk of a long one,
    has its row, the place in its text where it begins, and its place and length in the group."""
    parts: list[np.ndarray] = []
    row: list[int] = []
    base: list[int] = []
    held = 0

    def group():
        n = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.array(row), np.array(base), np.cumsum(n) - n, n

    for i, t in enumerate(texts):
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
        for k in range(0, len(codes) - LENGTH + 1, CHUNK):
            parts.append(codes[k : k + CHUNK + LENGTH - 1])
            row.append(i)
            base.append(k)
            held += len(parts[-1])
            if held >= size:
                yield group()
                parts, row, base, held = [], [], [], 0
    if parts:
        yield group()


_WINDOWS = "doc_id long, s0 int, s1 int, sig long, x long"
_PIECES = "j long, z long, sig long, x long, lo long, hi long, at int, y array<long>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for codes, row, base, first, n in _groups(b.column(1).to_pylist()):
            text, s0, s1, _, sig, x = compact_windows(codes, first, n)
            move = (base - first)[text]
            cols = [b.column(0).take(pa.array(row[text])), pa.array((s0 + move).astype("int32")), pa.array((s1 + move).astype("int32")), pa.array(sig.view("int64")), pa.array(x.view("int64"))]
            yield pa.RecordBatch.from_arrays(cols, names=_names(_WINDOWS))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of the listed windows (sig, x, s0, s1, lo, hi) of a text, each with the hashes of its stretches."""
    for b in batches:
        lists = [b.column(k) for k in range(1, 7)]
        begin = lists[0].offsets.to_numpy()
        sig, x, s0, s1, lo, hi = (v.values.to_numpy().astype("int64") for v in lists)
        for codes, text, base, first, _ in _groups(b.column(0).to_pylist()):
            # The windows of each text or chunk; a window lies in one chunk.
            count = begin[text + 1] - begin[text]
            unit = np.repeat(np.arange(len(text)), count)
            w = np.repeat(begin[text], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            here = s0[w] // CHUNK == base[unit] // CHUNK
            unit, w = unit[here], w[here]
            move = (first - base)[unit]
            row, p0, p1, joint, z, y = joint_pieces(codes, s0[w] + move, s1[w] + move)
            n = p1 - p0 + 1
            for k in range(0, len(row), 10_000):
                s = slice(k, k + 10_000)
                r, m = w[row[s]], n[s]
                flat = np.repeat(p0[s] - np.cumsum(m) + m, m) + np.arange(m.sum())
                each = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m)].astype("int32")), pa.array(y[flat].view("int64")))
                at = (p0[s] - move[row[s]] - s0[r]).astype("int32")
                yield pa.RecordBatch.from_arrays([*map(pa.array, (joint[s].view("int64"), z[s].view("int64"), sig[r], x[r], lo[r], hi[r], at)), each], names=_names(_PIECES))


def shared_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, span_start, span_end): the longest runs of characters of each text that lie in stretches of
    LENGTH characters found verbatim in the text of another doc_id.

    Positions count code points; span_end is exclusive. Null, empty and shorter texts share nothing; rows with a
    null doc_id are left out; repeated rows of one doc_id are one record, so its own repeats do not count. Windows and
    stretches are compared by 64-bit hashes of their text, and only under one 64-bit signature. No pairs of records
    are made, and no group is collected.
    """
    ship(docs.sparkSession)
    d = docs.where(f"doc_id is not null and length(text) >= {LENGTH}").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    win = materialize(d.mapInArrow(_windows, _WINDOWS))
    several = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]  # more than one record if these differ
    sigs = materialize(win.groupBy("sig").agg(*several).where("lo < hi").select("sig"))
    win = materialize(win.join(small(sigs), "sig", "left_semi").select("doc_id", "s0", "s1", "sig", "x"))
    # Classes of equal windows: the signature and the content tell everything else about a window.
    key = ["sig", "x"]
    cls = materialize(win.groupBy(*key).agg(*several, F.min(F.struct("doc_id", "s0", "s1")).alias("rep")))
    open_ = materialize(cls.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"))
    # Classes that differ from others of their signature: one representative each goes back to its text.
    todo = cls.join(small(open_), "sig", "left_semi").groupBy(F.col("rep.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(*key, "rep.s0", "rep.s1", "lo", "hi")).alias("w"))
    texts = d.join(small(materialize(todo)), "doc_id").select("text", "w.sig", "w.x", "w.s0", "w.s1", "w.lo", "w.hi")
    p = materialize(texts.mapInArrow(_pieces, _PIECES))
    several = [F.min("lo").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("n")]
    alike = materialize(p.groupBy("j", "z").agg(*several))
    # A joint signature with one content needs no more; under one with several, only stretches of contents of one record are open.
    joint = alike.groupBy("j").agg(F.min("a").alias("_a"), F.max("b").alias("_b"), F.count(F.lit(1)).alias("n")).where("_a < _b and n > 1").select("j")
    joint = materialize(joint)
    same = materialize(alike.where("a < b and n > 1").select("j", "z"))
    met = p.where("lo = hi").join(small(same), ["j", "z"], "left_semi").select(*key, F.col("at").alias("a"), (F.col("at") + F.size("y") - 1).alias("b"))
    st = p.join(small(joint), "j", "left_semi").join(small(same.withColumn("_s", F.lit(True))), ["j", "z"], "left")
    st = materialize(st.select("j", "z", *key, "lo", "hi", "at", "_s", F.posexplode("y").alias("_k", "y")).withColumn("at", F.col("at") + F.col("_k")).drop("_k"))
    common = materialize(st.groupBy("j", "y").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("j", "y"))
    part = st.where("lo = hi and _s is null").join(small(common), ["j", "y"], "left_semi").select(*key, "at").distinct()
    # Runs of neighbouring starts of a class.
    o = Window.partitionBy(*key).orderBy("at")
    part = part.withColumn("run", F.col("at") - F.row_number().over(o)).groupBy(*key, "run").agg(F.min("at").alias("a"), F.max("at").alias("b")).select(*key, "a", "b")
    whole = cls.where("lo < hi").select(*key, F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    hits = win.join(small(materialize(whole.unionByName(part).unionByName(met))), key).select("doc_id", (F.col("s0") + F.col("a")).alias("s"), (F.coalesce(F.col("s0") + F.col("b"), F.col("s1")) + LENGTH).alias("e"))
    return merge_spans(hits)


def merge_spans(hits: DataFrame) -> DataFrame:
    """Spans of one document that overlap or touch become one."""
    o = Window.partitionBy("doc_id").orderBy("s", "e")
    h = hits.withColumn("_b", F.max("e").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    h = h.withColumn("_i", F.sum(F.when(F.col("s") <= F.col("_b"), 0).otherwise(1)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("doc_id", "_i").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("_i")
