"""Recording files out of a table of readings: one file per session, in either container, streamed row by row."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.recording import TICK_COLUMNS
from ..util import ship

WRITTEN = "session_id long, file string, rows long"


def local_path(folder: str) -> str:
    """The folder as a path of the file system that all executors share."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("recording files are written to a shared file system")
    return folder.removeprefix("file://")


def _zip(path: str, symbol: str, con_id: int, rows: Iterator[tuple]) -> int:
    n, digest = 0, hashlib.sha256()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("ticks.csv", "w", force_zip64=True) as f:
            line = io.StringIO(newline="")
            w = csv.writer(line, lineterminator="\n")
            w.writerow(TICK_COLUMNS)
            for r in rows:
                w.writerow(["" if v is None else v for v in r])
                n += 1
                if n % 5000 == 0:
                    digest.update(b := line.getvalue().encode())
                    f.write(b)
                    line.seek(0)
                    line.truncate()
            digest.update(b := line.getvalue().encode())
            f.write(b)
        z.writestr("manifest.json", json.dumps({"format_version": 2, "contract": {"symbol": symbol, "con_id": con_id, "min_tick": 0.01}, "row_count": n}))
        z.writestr("checksums.json", json.dumps({"files": {"ticks.csv": digest.hexdigest()}}))
    return n


def _database(path: str, symbol: str, con_id: int, rows: Iterator[tuple]) -> int:
    with closing(sqlite3.connect(path)) as c:
        c.execute(f"create table ticks ({', '.join(TICK_COLUMNS)})")
        n = c.executemany(f"insert into ticks values ({', '.join('?' * len(TICK_COLUMNS))})", rows).rowcount
        n = max(n, 0)
        c.execute("create table metadata (key, value_json)")
        m = {"format_version": 3, "contract": {"symbol": symbol, "con_id": con_id, "min_tick": 0.01}, "row_count": n, "status": "complete"}
        c.executemany("insert into metadata values (?, ?)", [(k, json.dumps(v)) for k, v in m.items()])
        c.commit()
    return n


def write_recordings(ticks: DataFrame, folder: str) -> DataFrame:
    """Rows of WRITTEN: each session's readings, in order of their sequence, as a file of the shared folder - ZIP for even
    session ids, SQLite for odd ones. ``ticks`` has session_id and the columns of a recording. A file is written under a
    name of its own and renamed when it is whole, so a repeated task leaves one whole file. A session streams through its
    task; sessions are spread over the tasks. Rows with a null session are left out."""
    ship(ticks.sparkSession)
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)
    d = ticks.where("session_id is not null").select("session_id", *TICK_COLUMNS).repartition("session_id").sortWithinPartitions("session_id", "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tickloom.sinks import recordings as module

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for session, part in groupby(rows, key=lambda r: r[0]):
            first = next(part)
            symbol, con = first[1 + TICK_COLUMNS.index("symbol")], first[1 + TICK_COLUMNS.index("con_id")]
            name = f"session-{session}.{'db' if session % 2 else 'zip'}"
            temp = os.path.join(root, f".{name}-{os.getpid()}-{id(part)}")
            n = (module._database if session % 2 else module._zip)(temp, symbol, con, (r[1:] for p in ((first,), part) for r in p))
            os.replace(temp, os.path.join(root, name))
            yield pa.RecordBatch.from_arrays([pa.array([session], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], names=["session_id", "file", "rows"])

    return d.mapInArrow(run, WRITTEN)
