"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled in order, each by one merge gadget. The automaton starts with one state that loops on
every byte. The gadget of merge (u, v) -> w gives the arcs labelled u a new target, a copy of their old one
without the v arc, and adds beside every u arc an arc labelled w that leads where the v arc led. What results
accepts exactly the proper tokenizations, one for each byte string. A state and its copy differ in one arc, so
the gadgets' tables hold per state its parent, the arc it lost and its age, and per token its two halves.

Words are encoded by a table-driven automaton over bytes. Its states are sets of pairs: a place inside a token of the
vocabulary's trie, and the token before it on a path of the token automaton that spells the bytes read so far. Subset
construction compiles a state's row of the transition table when a word first reaches it; every later byte costs one
look into the table. Exactly one pair ends a token at each byte, which every state names, so the labels of the
accepting path are emitted from its end. Decoding emits the labels of the given arcs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import ship

#: Fixed value: the pattern by which byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words one worker remembers; the memory bound of the word cache.
CACHE_WORDS = 400_000
#: States of the transition table at which one worker begins a new table; its memory bound.
STATES = 1_000_000


class Automaton:
    """Compiled merges: ``merges`` are (left id, right id, new id) in order of application, ``labels`` the bytes of every id."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.labels = labels
        n = max(labels) + 1
        self.left, self.born = [-1] * n, [0] * n  # per token: its left half, the step that made it (0: a byte)
        self.parent, self.lost, self.age = [-1], [-1], [0]  # per state
        self.target = [0] * n  # per token: the state its arcs lead to
        self.arcs: dict[int, bool] = {}
        for step, (u, v, w) in enumerate(merges, 1):
            self._gadget(step, u, v, w)
        self.arcs.clear()
        self.size = [len(labels.get(t, b"")) for t in range(n)]
        self._trie()
        self._forget()
        self.words: dict[str, list[int]] = {}

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        old = self.target[u]
        if not self._arc(old, v):
            return  # the arc is gone already, so the merge can never apply
        self.target[w] = old if u == v else self.target[v]
        self.parent.append(old)
        self.lost.append(v)
        self.age.append(step)
        self.target[u] = len(self.parent) - 1
        self.left[w], self.born[w] = u, step

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc labelled with the token."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            s, t = state, token
            while True:
                if self.born[t] and self.born[t] >= self.age[s]:
                    t = self.left[t]  # the token came after the state: it was added beside the arc of its left half
                elif s == 0:
                    known = self.born[t] == 0
                    break
                elif self.lost[s] == t:
                    known = False
                    break
                else:
                    s = self.parent[s]  # both were there when the state was copied
            self.arcs[key] = known
        return known

    def _trie(self) -> None:
        """Places of the vocabulary's trie: per place the next one by byte, and the token that ends there."""
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, b in sorted(self.labels.items()):
            if not self.born[t] and len(b) > 1:
                continue  # no merge makes it, so no arc bears it
            at = 0
            for c in b:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                at = to
            self.ends[at] = t

    def _forget(self) -> None:
        """An empty transition table: the state before the first byte alone."""
        self.rows: list[dict[int, int]] = [{}]
        self.pairs: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.last: list[int] = [-1]
        self.numbers: dict[tuple, int] = {(self.pairs[0], -1): 0}

    def _compile(self, state: int, byte: int) -> int:
        """The target of a state's transition, which is put into the table."""
        pairs, last = [], -1
        for place, before in self.pairs[state]:
            to = self.next[place].get(byte)
            if to is None:
                continue
            t = self.ends[to]
            if t >= 0 and last < 0 and (before < 0 or self._arc(self.target[before], t)):
                last = t
            if self.next[to]:
                pairs.append((to, before))
        if last >= 0:
            pairs.append((0, last))
        key = (tuple(pairs), last)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.rows)
            self.rows.append({})
            self.pairs.append(key[0])
            self.last.append(last)
        self.rows[state][byte] = number
        return number

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one accepting path that spells the word."""
        if len(self.rows) >= STATES:
            self._forget()
        rows, path, state = self.rows, [], 0
        for c in word:
            to = rows[state].get(c)
            state = self._compile(state, c) if to is None else to
            path.append(state)
        out: list[int] = []
        last, size, n = self.last, self.size, len(word)
        while n:
            t = last[path[n - 1]]
            out.append(t)
            n -= size[t]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for w in _split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                if len(self.arcs) >= 8 * CACHE_WORDS:
                    self.arcs.clear()
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_split = regex.compile(PATTERN).findall
_loaded: dict[str, Automaton] = {}


def _halves(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: merge its bytes with the ranks below its own until two parts are left."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        r, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if r >= limit:
            raise ValueError(f"token {limit} cannot be reached by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def compiled(data: bytes) -> Automaton:
    """The automaton of a rank file's content (one base64 token and its rank a line), once per process."""
    key = hashlib.blake2b(data).hexdigest()
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        order = sorted((r, b) for b, r in ranks.items() if len(b) > 1)
        merges = ((ranks[x], ranks[y], r) for r, b in order for x, y in [_halves(ranks, b)])
        _loaded[key] = Automaton({r: b for b, r in ranks.items()}, merges)
    return _loaded[key]


def load(path: str = VOCABULARY) -> Automaton:
    """The automaton of a rank file."""
    with open(path, "rb") as f:
        return compiled(f.read())


def _sent(df: DataFrame, path: str):
    """A rank file as Spark brings it to the executors; only the driver needs the file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>): each text's ids without special tokens; null and empty texts have an empty list.

    Special tokens' spellings are ordinary text. Rows with a null or repeated id keep their place; extra columns
    are ignored; texts of any length are encoded whole. No shuffle: a map over the scan.
    """
    ship(docs.sparkSession)
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tickloom.llm import bpe

        enc = bpe.compiled(sent.value).encode
        for b in batches:
            ids = pa.array([enc(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    d = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, text): the arc labels of each list of ids."""
    ship(encoded.sparkSession)
    sent = _sent(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tickloom.llm import bpe

        a = bpe.compiled(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
