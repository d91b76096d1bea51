"""Pair records of two tables with the nearest record in time of the same entity.

The union of both tables is range-partitioned by (entity, time), so an entity of any size spreads over as many
tasks as it needs. Each partition is scanned locally, vectorised, block by block, so a task holds BLOCK_ROWS rows
however large its partition is. What a block cannot know - the right records just beyond its edges - is exchanged
through its edge records, at most two per block, by a parallel prefix scan: chunks of neighbouring partitions are
scanned each by itself, then the chunks' totals, and both are put together. The result joins the pending left records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, plan_bytes, ship, small

#: Rows scanned at once by a task.
BLOCK_ROWS = 500_000
#: Bytes of input for which one range partition is made, if the session's own number is smaller.
PARTITION_BYTES = 64 << 20
#: Bits of a block's number inside its partition, and of the partitions of one chunk of the prefix scan.
_BLOCK_BITS, _CHUNK_BITS = 24, 5

_OUT = "kind string, part long, e string, lid string, t long, pt long, pk long, nt long, nk long"


def _schema(payload: list[str]) -> str:
    return ", ".join([_OUT, *[f"{side}_{p} double" for p in payload for side in "pn"]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scan(tab: pa.Table, part: int, payload: list[str]) -> Iterator[pa.RecordBatch]:
    """One sorted block: left rows with the right records around them, and the block's edges."""
    col = {n: tab[n].combine_chunks() for n in tab.column_names}
    col = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in col.items()}
    n = tab.num_rows
    e = pc.dictionary_encode(col["e"]).indices.to_numpy(zero_copy_only=False)
    t = col["t"].to_numpy()
    right = col["side"].to_numpy() == 0
    k = col["k"].fill_null(0).to_numpy()
    at = np.arange(n)
    new_e = np.r_[True, e[1:] != e[:-1]]
    first = np.maximum.accumulate(np.where(new_e, at, 0))  # first row of the entity
    last_of = np.r_[new_e[1:], True]
    last = np.minimum.accumulate(np.where(last_of, at, n)[::-1])[::-1]
    same = np.maximum.accumulate(np.where(new_e | np.r_[True, t[1:] != t[:-1]], at, 0))  # first row of the instant: its right record of the smallest id
    prev = np.maximum.accumulate(np.where(right, at, -1))
    prev_ok = prev >= first
    nxt = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    nxt_ok = nxt <= last

    def emit(kind: str, rows: np.ndarray, p: np.ndarray, p_ok: np.ndarray, q: np.ndarray, q_ok: np.ndarray) -> pa.RecordBatch:
        pp, qq = same[np.where(p_ok, p, 0)], same[np.where(q_ok, q, 0)]
        take = pa.array(rows)
        cols = [
            pa.array([kind] * len(rows), pa.string()), pa.array(np.full(len(rows), part)), pc.take(col["e"], take).cast(pa.string()), pc.take(col["lid"], take).cast(pa.string()), pa.array(t[rows]),
            pa.array(t[pp], mask=~p_ok), pa.array(k[pp], mask=~p_ok), pa.array(t[qq], mask=~q_ok), pa.array(k[qq], mask=~q_ok),
        ]
        for name in payload:
            cols += [pc.take(col[f"v_{name}"], pa.array(pp, mask=~p_ok)), pc.take(col[f"v_{name}"], pa.array(qq, mask=~q_ok))]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _schema(payload).split(", ")])

    rows = np.flatnonzero(~right)
    for i in range(0, len(rows), 50_000):
        r = rows[i : i + 50_000]
        yield emit("left", r, prev[r], prev_ok[r], nxt[r], nxt_ok[r])
    # Edges: of the block's first and last entity, the latest right record (pt, pk) and the first (nt, nk).
    heads = np.unique([first[0], first[n - 1]])
    ends = last[heads]
    yield emit("edge", heads, prev[ends], prev[ends] >= heads, nxt[heads], nxt[heads] <= ends)


def _exchange(edge: DataFrame, before: Column, after: Column) -> DataFrame:
    """(part, e, before, after): for each edge the nearest right record of the blocks before and after it, as a prefix
    scan in both directions over chunks of neighbouring partitions and over the chunks' totals."""
    edge = edge.select("part", "e", F.shiftright("part", _BLOCK_BITS + _CHUNK_BITS).alias("chunk"), before.alias("b"), after.alias("a"))

    def scan(df: DataFrame, keys: list[str], by: str, b: str, a: str) -> DataFrame:
        up = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({b: F.max("b").over(up), a: F.min("a").over(down)})

    inside = scan(edge, ["e", "chunk"], "part", "b1", "a1")
    totals = scan(edge.groupBy("e", "chunk").agg(F.max("b").alias("b"), F.min("a").alias("a")), ["e"], "chunk", "b2", "a2").drop("a", "b")
    both = inside.join(totals, ["e", "chunk"])
    return both.select("part", "e", F.greatest("b1", "b2").alias("before"), F.least("a1", "a2").alias("after")).where("before is not null or after is not null")


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int, backward: bool = False, payload: tuple[str, ...] = ()) -> DataFrame:
    """Rows (lid, t, rid, rt) and the payload: each left record (e, lid, t) with its nearest right record (e, rid, t).

    e is text, lid text, rid a long, t epoch microseconds. The nearest is the one of least distance, before or
    after, at most ``tolerance_us`` away; of equally near instants the earlier, of one instant the smallest rid.
    With ``backward`` only right records at or before the left one count. payload names double columns of the right
    record that come along. Left records without a partner are left out; rows with a null e, t or id, on either side,
    match nothing. Repeated rows on either side change nothing. Empty tables give an empty result.
    """
    ship(left.sparkSession)
    names = list(payload)
    r = right.where("e is not null and t is not null and rid is not null").select(
        "e", "t", F.lit(0).alias("side"), F.col("rid").alias("k"), F.lit(None).cast("string").alias("lid"), *[F.col(p).cast("double").alias(f"v_{p}") for p in names]
    )
    a = left.where("e is not null and t is not null and lid is not null").select("e", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("k"), "lid").distinct()
    u = r.unionByName(a, allowMissingColumns=True)
    keys = ["e", "t", "side", "k", "lid"]
    size = plan_bytes(u)  # beyond a thousand terabytes it is not known
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES if size < 1 << 50 else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tickloom.llm import nearest

        part = TaskContext.get().partitionId() << nearest._BLOCK_BITS
        for i, block in enumerate(nearest._blocks(batches)):
            yield from nearest._scan(block, part + i, names)

    scanned = materialize(u.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, _schema(names)))
    # Records as structs that order by nearness; ids count down where the latest is the greatest.
    pair = lambda t, k, side: F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("t"), k.alias("k"), *[F.col(f"{side}_{p}").alias(p) for p in names]))
    here, there = pair("pt", -F.col("pk"), "p"), pair("nt", F.col("nk"), "n")
    carry = _exchange(scanned.where("kind = 'edge'"), here, there)
    j = scanned.where("kind = 'left'").join(small(materialize(carry)), ["part", "e"], "left")
    j = j.select("lid", "t", F.greatest(here, F.col("before")).alias("b"), F.least(there, F.col("after")).alias("a"))
    db, da = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    take: Column = F.col("a").isNull() | (F.col("b").isNotNull() & (db <= da))
    if backward:
        take = F.lit(True)
    either = lambda c: F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    got = j.select("lid", "t", F.when(take, -F.col("b.k")).otherwise(F.col("a.k")).alias("rid"), either("t").alias("rt"), *[either(p).alias(p) for p in names])
    return got.where(f"rid is not null and abs(rt - t) <= {int(tolerance_us)}")
