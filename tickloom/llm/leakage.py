"""Find evaluation passages, whole or in part, inside a corpus.

Windows of a text are compared with windows of the items of the same size: a window of the item's own size finds
passages of which most words stand, and windows of LEAK_WORDS words find the shortest part that counts. A window has
a 64-bit SimHash of its shingles of SHINGLE words, each counted as often as it occurs. The items' fingerprints lie in
a multi-index of bit blocks that yields every fingerprint within the radius; the candidates are verified by the
weighted Jaccard similarity of their shingles, NEAR or more.

The radius follows from the similarity bound and the window's size (``radius``). Two windows of LEAK_WORDS words have
six shingles each, so similarity 0.8 leaves no shingle unshared: their radius is 0. For item-sized windows it is the
expected distance at similarity NEAR and three standard deviations more.

So large a radius is no filter for each window of a corpus. A bound that loses nothing comes first: of two windows with
n shingles each, similarity NEAR leaves at most n * (1 - NEAR) / (1 + NEAR) unshared, so a window with more shingles
that no passage of its size has needs no fingerprint.

The corpus is mapped over without a shuffle. The items are hashed in Spark and sent along in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import acos, ceil, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import materialize, ship

#: Words of the shortest leak.
LEAK_WORDS = 10
#: Words of a shingle.
SHINGLE = 5
#: Least weighted-shingle similarity of two windows.
NEAR = 0.8
#: Bit blocks of the multi-index, and the largest distance inside one: any two fingerprints within
#: BLOCKS * (BLOCK_RADIUS + 1) - 1 = 19 bits agree but for BLOCK_RADIUS bits in at least one block.
BLOCKS = 4
BLOCK_RADIUS = 4
#: Words of one block of items; its index takes about 150 MB at most.
BLOCK_WORDS = 2_000_000
#: Words handled at once, or four of the largest windows where these are longer; bounds a task's memory however long a text is.
SLAB = 60_000

_DROP = {0x00AD: None, 0x200B: None}
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\[/?[A-Za-z][^\[\]]*\]|&#?[A-Za-z0-9]+;")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of the lower-cased text, without soft hyphens and zero-width spaces, tags and entities as blanks."""
    return _WORD.findall(_MARKUP.sub(" ", text.translate(_DROP)).lower()) if text else []


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_hash = _Hashes()


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash.__getitem__, ws), "uint64", len(ws))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray) -> np.ndarray:
    """The hash of every run of SHINGLE words."""
    n = max(len(h) - SHINGLE + 1, 0)
    total = np.zeros(n, "uint64")
    for j in range(SHINGLE if n else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]  # modulo 2^64
    return _mixed(total)


def unshared(n: int) -> int:
    """Of two windows with n shingles each and similarity NEAR or more, the most shingles of one that the other lacks."""
    return floor(n * (1 - NEAR) / (1 + NEAR) + 1e-9)


def radius(n: int) -> int:
    """The Hamming radius for windows with n shingles: the distance of two SimHashes is binomial with the angle between
    the windows as its rate, which at similarity NEAR has cosine 1 - unshared / n; the mean and three deviations more."""
    u = unshared(n)
    if not u:
        return 0
    p = acos(1 - u / n) / pi
    return min(ceil(64 * p + 3 * sqrt(64 * p * (1 - p))), BLOCKS * (BLOCK_RADIUS + 1) - 1)


class _Sums:
    """Fingerprints of any windows of one run of shingles, from prefix sums of their bits."""

    def __init__(self, sh: np.ndarray):
        self.total = np.zeros((len(sh) + 1, 64), "int32")
        np.cumsum(np.unpackbits(sh.view("uint8").reshape(-1, 8), axis=1), axis=0, out=self.total[1:])

    def of(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """SimHash of the n shingles from each first one on."""
        ones = self.total[first + n] - self.total[first]
        return np.packbits(ones * 2 > np.asarray(n).reshape(-1, 1), axis=1).view("uint64").ravel()


def fingerprint(h: np.ndarray) -> int:
    """SimHash of one window of word hashes."""
    sh = shingles(h)
    return int(_Sums(sh).of(np.array([0]), np.array([len(sh)]))[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of the shingles of two windows of word hashes, each shingle weighted by its count."""
    return _weighted(*np.unique(shingles(a), return_counts=True), shingles(b))


def _weighted(u: np.ndarray, count: np.ndarray, other: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(u, other), len(u) - 1)
    both = np.minimum(np.bincount(at[u[at] == other], minlength=len(u)), count).sum()
    return float(both / (count.sum() + len(other) - both))


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row the places lo, lo + 1, .. of its n entries."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class MultiIndex:
    """Fingerprints by bit blocks: ``within`` yields every indexed one within a radius of up to 19 bits."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.tables = fp, []
        width = 64 // BLOCKS
        for at in range(0, 64, width):
            key = ((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype("int64")
            start = np.zeros((1 << width) + 1, "int64")
            np.cumsum(np.bincount(key, minlength=1 << width), out=start[1:])
            self.tables.append((np.uint64(at), start, np.argsort(key, kind="stable"), np.diff(start) > 0))
        near = np.arange(1 << width, dtype="int64")
        bits = np.bitwise_count(near)
        self.masks = [near[bits <= r] for r in range(BLOCK_RADIUS + 1)]

    def within(self, fp: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): all pairs of a given fingerprint and an indexed one at most ``most`` of its row apart."""
        rows, found = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for r in np.unique(most // BLOCKS):  # at least one block has no more than its share of the differences
            mask = self.masks[int(r)]
            of = np.flatnonzero(most // BLOCKS == r)
            step = max(1, 1_000_000 // len(mask))
            for i in range(0, len(of), step):
                g = of[i : i + step]
                for at, start, order, some in self.tables:
                    key = ((fp[g] >> at) & np.uint64(len(start) - 2)).astype("int64")[:, None] ^ mask
                    full = np.flatnonzero(some[key])
                    key = key.ravel()[full]
                    row, place = _spread(start[key], start[key + 1] - start[key])
                    row, hit = g[full[row] // len(mask)], order[place]
                    ok = np.bitwise_count(fp[row] ^ self.fp[hit]) <= most[row]
                    rows.append(row[ok])
                    found.append(hit[ok])
        pair = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)]), axis=1)
        return pair[0], pair[1]


class Index:
    """Windows of a block of items: whole passages in a multi-index, and every run of LEAK_WORDS words by its fingerprint."""

    def __init__(self, items: list[np.ndarray]):
        # Items with the same words are one passage with several owners.
        groups: dict[bytes, list[int]] = {}
        for i, h in enumerate(items):
            if len(h) >= LEAK_WORDS:
                groups.setdefault(h.tobytes(), []).append(i)
        self.passages = [np.frombuffer(k, "uint64") for k in groups]
        self.owners = list(groups.values())
        self.size = np.array([len(p) for p in self.passages], "int64")
        self.sizes = np.unique(self.size)
        self.flat = np.concatenate([np.zeros(0, "uint64"), *self.passages])
        base = np.r_[0, np.cumsum(self.size)].astype("int64")
        sh = shingles(self.flat)  # shingles across borders of passages are never asked for, but for the table of bits
        sums = _Sums(sh)
        n = self.size - SHINGLE + 1
        self.whole = MultiIndex(sums.of(base[:-1], n) if len(n) else np.zeros(0, "uint64"))
        self.counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row, self.part = _spread(base[:-1], self.size - LEAK_WORDS + 1)
        fp = sums.of(self.part, np.full(len(self.part), LEAK_WORDS - SHINGLE + 1))
        order = np.argsort(fp, kind="stable")
        self.part, self.part_fp, self.part_of = self.part[order], fp[order], row[order]
        # Most shingles of a corpus are no item's: a table of bits tells without a search.
        self.some = np.zeros(1 << 25, bool)
        within, at = _spread(base[:-1], n)
        self.some[(sh[at] >> np.uint64(39)).astype("int64")] = True
        # Every shingle with the sizes of the passages that hold it.
        held = np.unique(np.stack([sh[at], self.size[within].astype("uint64")]), axis=1)
        self.held, self.held_size = held[0], held[1].astype("int64")

    def sizes_of(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, position) of all given shingles that a passage of that size holds, ordered by size and position."""
        at = np.flatnonzero(self.some[(sh >> np.uint64(39)).astype("int64")])
        lo, hi = np.searchsorted(self.held, sh[at]), np.searchsorted(self.held, sh[at], side="right")
        row, place = _spread(lo, hi - lo)
        size, at = self.held_size[place], at[row]
        order = np.lexsort((at, size))
        return size[order], at[order]

    def shingle_counts(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self.counted:
            self.counted[p] = np.unique(shingles(self.passages[p]), return_counts=True)
        return self.counted[p]


_built: dict[str, Index] = {}


def _index(key: str, items: list[np.ndarray]) -> Index:
    """The index of a block of items, kept by the worker for its next task."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(items)
    return _built[key]


def _parts(h: np.ndarray, seen: np.ndarray, sums: _Sums, ix: Index, inside) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, passage, whether all words are equal) of the windows of LEAK_WORDS words; seen counts the shingles that items have."""
    n = LEAK_WORDS - SHINGLE + 1
    at = np.arange(max(len(seen) - n, 0))
    at = at[seen[at + n] - seen[at] >= n - unshared(n)]
    at = at[inside(at, LEAK_WORDS)]
    fp = sums.of(at, np.full(len(at), n))
    lo, hi = np.searchsorted(ix.part_fp, fp), np.searchsorted(ix.part_fp, fp, side="right")
    row, place = _spread(lo, hi - lo)  # radius 0: one block of all bits
    pos, part, passage = at[row], ix.part[place], ix.part_of[place]
    run = np.arange(LEAK_WORDS)
    same = np.ones(len(pos), bool)
    for i in range(0, len(pos), 50_000):
        s = slice(i, i + 50_000)
        same[s] = (h[pos[s, None] + run] == ix.flat[part[s, None] + run]).all(axis=1)
    ok = same.copy()
    for i in np.flatnonzero(~same):
        ok[i] = similarity(h[pos[i] : pos[i] + LEAK_WORDS], ix.flat[part[i] : part[i] + LEAK_WORDS]) >= NEAR
    return pos[ok], passage[ok], same[ok]


def _wholes(sh: np.ndarray, seen: np.ndarray, sums: _Sums, ix: Index, inside, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, passage, similarity) of the item-sized windows; starts and lens are whole texts, which are windows for longer items."""
    first, size, whole = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, bool)]

    def add(at: np.ndarray, words: np.ndarray, full: bool) -> None:
        first.append(at)
        size.append(words)
        whole.append(np.full(len(at), full))

    held, place = ix.sizes_of(sh)
    for w in ix.sizes:
        n = int(w) - SHINGLE + 1
        mine = place[np.searchsorted(held, w) : np.searchsorted(held, w, side="right")]
        if len(mine) < n - unshared(n):
            continue
        own = np.zeros(len(sh) + 1, "int64")  # counts the shingles that passages of this size have
        np.cumsum(np.bincount(mine, minlength=len(sh)), out=own[1:])
        at = np.arange(max(len(own) - n, 0))
        at = at[own[at + n] - own[at] >= n - unshared(n)]
        at = at[inside(at, int(w))]
        add(at, np.full(len(at), w), False)
    if len(ix.sizes):
        few = lens - SHINGLE + 1
        # A text shorter than the item shares at most its own shingles.
        ok = (lens < ix.sizes[-1]) & (few >= NEAR * (ix.sizes[0] - SHINGLE + 1)) & (few > 0)
        at, few = starts[ok], few[ok]
        enough = seen[at + few] - seen[at] >= few * (1 - (1 - NEAR) / (1 + NEAR)) - 1e-9
        add(at[enough], few[enough] + SHINGLE - 1, True)
    at, w, full = (np.concatenate(x) for x in (first, size, whole))
    n = w - SHINGLE + 1
    # A short text lacks shingles of the item, so its own number of shingles does not bound the distance.
    most = np.where(full, BLOCKS * (BLOCK_RADIUS + 1) - 1, np.array([radius(int(x)) for x in n], "int64")) if len(at) else at
    row, p = ix.whole.within(sums.of(at, n), most) if len(at) else (at, at)
    fits = np.where(full[row], ix.size[p] > w[row], ix.size[p] == w[row])
    row, p = row[fits], p[fits]
    sim = np.array([_weighted(*ix.shingle_counts(q), sh[at[r] : at[r] + n[r]]) for r, q in zip(row, p.tolist())])
    ok = sim >= NEAR - 1e-12
    return at[row][ok], p[ok], sim[ok]


def _scan(hashes: list[np.ndarray], ix: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, passage, equal parts, similarity) of verified windows of texts of word hashes, summed per slab."""
    if not len(ix.sizes):
        return
    widest = int(ix.sizes[-1])
    slab = max(SLAB, 4 * widest)
    doc: list[int] = []
    parts: list[np.ndarray] = []
    whole: list[bool] = []
    again: list[int] = []  # words of a piece that the piece before it had too

    def flush():
        h = np.concatenate(parts)
        lens = np.array([len(p) for p in parts])
        sh = shingles(h)
        if not len(sh):
            return None
        have = ix.some[(sh >> np.uint64(39)).astype("int64")]
        piece = np.repeat(np.arange(len(parts)), lens)
        inner = piece[: len(sh)] == piece[SHINGLE - 1 :]
        # Only texts with enough shingles of items go on.
        enough = np.bincount(piece[: len(sh)][have & inner], minlength=len(parts)) >= LEAK_WORDS - SHINGLE + 1
        if not enough.any():
            return None
        h, lens = np.concatenate([p for p, e in zip(parts, enough) if e]), lens[enough]
        docs, full, lap = np.array(doc)[enough], np.array(whole)[enough], np.array(again)[enough]
        sh = shingles(h)
        seen = np.r_[0, np.cumsum(ix.some[(sh >> np.uint64(39)).astype("int64")])]
        sums = _Sums(sh)
        starts = np.cumsum(lens) - lens
        piece = np.repeat(np.arange(len(lens)), lens)
        offset = np.arange(len(h)) - starts[piece]

        def inside(at: np.ndarray, size: int) -> np.ndarray:
            # A window that lies in the words shared with the piece before was seen there.
            return (piece[at] == piece[at + size - 1]) & (offset[at] + size > lap[piece[at]])

        pos, passage, same = _parts(h, seen, sums, ix, inside)
        at, q, sim = _wholes(sh, seen, sums, ix, inside, starts[full], lens[full])
        pos, passage, same = np.r_[pos, at], np.r_[passage, q], np.r_[same, np.zeros(len(at), bool)]
        sim = np.r_[np.zeros(len(pos) - len(at)), sim]
        pair, inv = np.unique(np.stack([docs[piece[pos]], passage]), axis=1, return_inverse=True)
        inv = inv.ravel()
        best = np.zeros(pair.shape[1])
        np.maximum.at(best, inv, sim)
        return pair[0], pair[1], np.bincount(inv[same], minlength=pair.shape[1]), best

    size = 0
    for i, h in enumerate(hashes):
        if len(h) < SHINGLE:
            continue
        for k in range(0, max(len(h) - widest + 1, 1), slab - widest + 1):
            doc.append(i)
            parts.append(h[k : k + slab])
            whole.append(len(h) <= slab)
            again.append(widest - 1 if k else 0)
            size += len(parts[-1])
            if size >= slab:
                got = flush()
                doc, parts, whole, again, size = [], [], [], [], 0
                if got is not None and len(got[0]):
                    yield got
    if parts:
        got = flush()
        if got is not None and len(got[0]):
            yield got


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, words, hashes as bytes), for texts of SHINGLE words and more."""
    for b in batches:
        hs = [word_hashes(words(t)) for t in b.column(1).to_pylist()]
        keep = [i for i, h in enumerate(hs) if len(h) >= SHINGLE]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep, pa.int64())), pa.array([len(hs[i]) for i in keep], pa.int64()), pa.array([hs[i].tobytes() for i in keep], pa.binary())], names=["id", "n", "h"]
        )


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, exact, parts, similarity): documents and items that share windows.

    exact tells whether LEAK_WORDS consecutive words are shared, parts counts the equal pairs of such windows, and
    similarity is the best of the document's windows of the item's own size - of the whole document, where the item is
    longer - or null where none has NEAR or more. A pair has a row if it is exact or has a similarity. Items shorter
    than LEAK_WORDS words, and null, empty and short texts match nothing; null ids are left out; items sharing a
    passage are all reported; of a repeated document or of different passages of one id the parts are summed. Extra columns are ignored. No cap on
    candidates; the corpus is read and hashed once, whatever the number of items.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    t = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("string").alias("id"), "passage").distinct()
    t = materialize(t.mapInArrow(_hash_texts, "id string, n long, h binary").where(f"n >= {LEAK_WORDS}"))
    blocks = ceil((t.agg(F.sum("n")).first()[0] or 0) / BLOCK_WORDS) or 1
    if blocks > 1:  # the words are hashed once for all blocks
        d = materialize(d.mapInArrow(_hash_texts, "id long, n long, h binary"))
    hashed = blocks > 1

    def over(block: pa.Table) -> DataFrame:
        names, rows = block["id"].to_pylist(), block["h"].to_pylist()
        sent = spark.sparkContext.broadcast((names, rows))
        key = xxhash.xxh3_128_hexdigest(b"".join(n.encode() + b"\0" + h for n, h in zip(names, rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tickloom.llm import leakage

            names, rows = sent.value
            ix = leakage._index(key, [np.frombuffer(h, "uint64") for h in rows])
            for b in batches if hashed else leakage._hash_texts(batches):
                for doc, passage, parts, best in leakage._scan([np.frombuffer(h, "uint64") for h in b.column(2).to_pylist()], ix):
                    row, item = leakage._owners(ix, passage)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc[row])), pa.array([names[i] for i in item], pa.string()), pa.array(parts[row].astype("int64")), pa.array(best[row], mask=best[row] == 0)],
                        names=["doc_id", "item_id", "parts", "similarity"],
                    )

        return d.mapInArrow(run, "doc_id long, item_id string, parts long, similarity double")

    out: DataFrame | None = None
    for k in range(blocks):
        part = over((t if blocks == 1 else t.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)).toArrow())
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("doc_id", "item_id").agg(F.sum("parts").alias("parts"), F.max("similarity").alias("similarity"))
    return out.select("doc_id", "item_id", (F.col("parts") > 0).alias("exact"), "parts", "similarity")


def _owners(ix: Index, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item): the items that own each row's passage."""
    own = [ix.owners[p] for p in passage.tolist()]
    return np.repeat(np.arange(len(own)), [len(o) for o in own]), np.array([i for o in own for i in o], "int64")
