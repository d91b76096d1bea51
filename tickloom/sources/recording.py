"""Readers of tick recordings and bot databases as Spark data sources.

``spark.read.format("tick_recording")`` reads recording files of either container - a ZIP with manifest.json and
ticks.csv, or an SQLite file with metadata and ticks tables - one partition a file. ``recording_info``, ``recording_events``
and ``recording_periods`` read what else such files hold: one row of metadata and broken rules without a scan of the ticks,
the events, and the scheduled periods. ``spark.read.format("sqlite_table")`` reads one table of SQLite files, whatever
columns it has; simple filters are pushed into SQLite.
"""

from __future__ import annotations

import csv
import glob
import hashlib
import io
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

#: Limits of a container, the SQLite file mark, the columns of a recorded tick.
MAX_MEMBERS = 64
MAX_EXPANDED = 2 << 30
SQLITE_MARK = b"SQLite format 3\x00"
TICK_COLUMNS = [
    "sequence", "captured_at_utc", "elapsed_ns", "symbol", "con_id", "source_time_utc", "bid", "bid_size", "ask", "ask_size", "last", "last_size", "open", "high", "low", "close", "volume", "mark_price", "market_data_type", "changed_fields", "rth_period_id",
]
_LONG, _TEXT = {"sequence", "elapsed_ns", "con_id"}, {"captured_at_utc", "symbol", "source_time_utc", "changed_fields"}
_INT = {"market_data_type", "rth_period_id"}
SCHEMA = "recording string, sha256 string, " + ", ".join(f"{c} {'bigint' if c in _LONG else 'string' if c in _TEXT else 'int' if c in _INT else 'double'}" for c in TICK_COLUMNS) + ", error string"


class RecordingError(ValueError):
    """A container that breaks a rule; the message names the rule."""


def members(z: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """The files of an archive, checked: a bounded number, no name twice, none that leaves the archive, bounded when expanded."""
    infos = z.infolist()
    if len(infos) > MAX_MEMBERS:
        raise RecordingError("too many members")
    names = [i.filename for i in infos]
    if len(set(names)) < len(names):
        raise RecordingError("a member name twice")
    if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n for n in names):
        raise RecordingError("a member outside the archive")
    if sum(i.file_size for i in infos) > MAX_EXPANDED:
        raise RecordingError("expands too far")
    return dict(zip(names, infos))


def verify_checksums(z: zipfile.ZipFile, names: dict[str, zipfile.ZipInfo]) -> list[str]:
    """Members whose SHA-256 differs from checksums.json; without that file none is checked."""
    if "checksums.json" not in names:
        return []
    want = json.loads(z.read("checksums.json")).get("files", {})
    return sorted(n for n, h in want.items() if n not in names or hashlib.sha256(z.read(n)).hexdigest() != str(h).lower())


#: What a manifest may say.
VERSIONS = {"zip": 2, "sqlite": 3}
STATUSES = {"recording", "complete", "interrupted", "error"}


def _whole(v: object) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else None


def manifest_problems(m: object, container: str) -> list[str]:
    """The rules that a manifest breaks, by name; none if it is sound."""
    if not isinstance(m, dict):
        return ["no JSON object"]
    c = m.get("contract")
    rows = m.get("row_count", 0)
    tick = c.get("min_tick", c.get("minTick")) if isinstance(c, dict) else None
    checks = {
        "format_version": m.get("format_version") == VERSIONS[container],
        "contract": isinstance(c, dict),
        "symbol": isinstance(c, dict) and bool(str(c.get("symbol") or "").strip()),
        "con_id": isinstance(c, dict) and _whole(c.get("con_id", c.get("conId", 0))) is not None,
        "min_tick": isinstance(tick, (int, float)) and 0 < tick < float("inf"),
        "row_count": _whole(rows) is not None,
        "status": container == "zip" or str(m.get("status") or "").strip().lower() in STATUSES,
        "committed_row_count": container == "zip" or m.get("committed_row_count", rows) == rows,
    }
    return [name for name, ok in checks.items() if not ok]


def _contract(m: object) -> tuple[str | None, int | None]:
    c = m.get("contract") if isinstance(m, dict) else None
    if not isinstance(c, dict):
        return None, None
    return str(c.get("symbol") or "").upper().strip() or None, _whole(c.get("con_id", c.get("conId"))) or None


def _value(column: str, raw: object) -> object:
    if raw is None or raw == "":
        return None
    if column in _TEXT:
        return str(raw)
    if column in _LONG or column in _INT:
        f = float(raw)
        if f != int(f):
            raise ValueError(f"{column} is no whole number")
        return int(raw) if isinstance(raw, int) else int(f) if abs(f) < 1 << 53 else int(str(raw))
    return float(raw)


def read_recording(path: str) -> Iterator[tuple]:
    """Rows of SCHEMA from one file. A row that does not parse has its values null and the reason in error."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        mark = f.read(16)
        f.seek(0)
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    head = (os.path.basename(path), digest.hexdigest())
    symbol, con_id = _contract(_manifest(path)[1])
    for row in _sqlite_rows(path) if mark == SQLITE_MARK else _zip_rows(path):
        try:
            values, error = [_value(c, row.get(c)) for c in TICK_COLUMNS], None
            if symbol and values[3] and values[3].upper().strip() != symbol or con_id and values[4] and values[4] != con_id:
                raise ValueError("another contract than the manifest's")
            if any(values[TICK_COLUMNS.index(c)] is not None and values[TICK_COLUMNS.index(c)] < 0 for c in ("bid_size", "ask_size", "last_size", "volume")):
                raise ValueError("a negative size")
            if values[18] is not None and values[18] not in (1, 2, 3, 4):
                raise ValueError("market_data_type out of range")
            if any(v is not None and v < 0 for v in (values[0], values[2])):
                raise ValueError("a negative counter")
        except (TypeError, ValueError) as e:
            values, error = [None] * len(TICK_COLUMNS), str(e)
        yield (*head, *values, error)
    again = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            again.update(block)
    if again.hexdigest() != head[1]:
        raise RecordingError(f"{head[0]} changed while it was read")


def _manifest(path: str) -> tuple[str, object]:
    """(container, manifest) of a file, without its ticks; the manifest is None where there is none that parses."""
    with open(path, "rb") as f:
        kind = "sqlite" if f.read(16) == SQLITE_MARK else "zip"
    try:
        if kind == "zip":
            with zipfile.ZipFile(path) as z:
                return kind, json.loads(z.read(members(z)["manifest.json"]))
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
            found = dict(c.execute("select key, value_json from metadata"))
            return kind, json.loads(found["manifest"]) if "manifest" in found else {k: json.loads(v) for k, v in found.items()}
    except (KeyError, ValueError, sqlite3.Error, zipfile.BadZipFile):
        return kind, None


INFO = "recording string, container string, bytes bigint, format_version int, symbol string, con_id bigint, row_count bigint, periods bigint, status string, problems array<string>"
EVENTS = "recording string, sequence bigint, created_at_utc string, event_type string, error_code int, payload string, error string"
PERIODS = "recording string, period_id int, schedule_open_utc string, schedule_close_utc string, observed_start_utc string, observed_end_utc string, status string, error string"


def read_info(path: str) -> Iterator[tuple]:
    """The row of INFO of one file, from its metadata alone."""
    kind, m = _manifest(path)
    d = m if isinstance(m, dict) else {}
    symbol, con_id = _contract(d)
    yield (
        os.path.basename(path), kind, os.path.getsize(path), _whole(d.get("format_version")), symbol, con_id, _whole(d.get("row_count", 0)), _whole(d.get("rth_period_count", 0)), str(d["status"]).lower() if d.get("status") else None, manifest_problems(m, kind),
    )


def read_events(path: str) -> Iterator[tuple]:
    """Rows of EVENTS from one file: the lines of events.jsonl or the table of events. An event's fields may stand in a
    nested payload; what is no JSON object has its reason in error."""
    name, (kind, _) = os.path.basename(path), _manifest(path)
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            lines = z.read("events.jsonl").decode("utf-8-sig", "replace").splitlines() if "events.jsonl" in members(z) else []
        found = [(i, None, None, line) for i, line in enumerate(lines, 1) if line.strip()]
    else:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
            has = c.execute("select 1 from sqlite_master where type = 'table' and name = 'events'").fetchone()
            found = c.execute("select sequence, created_at_utc, event_type, payload_json from events order by sequence").fetchall() if has else []
    for n, at, what, text in found:
        try:
            v = json.loads(text or "{}")
            if not isinstance(v, dict):
                raise ValueError("no JSON object")
            inner = v.get("payload")
            flat = v | (inner if isinstance(inner, dict) else {})
            code = flat.get("error_code")
            code = int(code) if isinstance(code, (int, float)) or str(code).lstrip("-").isdigit() else None
            yield name, n, at or flat.get("created_at_utc"), what or flat.get("event_type"), code, text, None
        except ValueError as e:
            yield name, n, at, what, None, text, str(e)


def read_periods(path: str) -> Iterator[tuple]:
    """Rows of PERIODS from one SQLite file; ZIP files have none. A period that is still active ends with its last reading,
    or where it starts."""
    name, (kind, _) = os.path.basename(path), _manifest(path)
    if kind == "zip":
        return
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
        c.row_factory = sqlite3.Row
        if not c.execute("select 1 from sqlite_master where type = 'table' and name = 'rth_periods'").fetchone():
            return
        for r in c.execute("select * from rth_periods order by period_id"):
            p, status, error = dict(r), str(r["status"] or "").strip().lower(), None
            end = str(p.get("observed_end_utc") or "").strip() or None
            if status == "active" and end is None:
                last = c.execute("select max(captured_at_utc) from ticks where rth_period_id = ?", (p["period_id"],)).fetchone()[0]
                end = max(filter(None, (last, p["observed_start_utc"])), default=None)
            if status not in ("active", "closed"):
                error = "status"
            elif not p["period_id"] or p["period_id"] < 1:
                error = "period_id"
            elif not (p["schedule_open_utc"] or "") < (p["schedule_close_utc"] or ""):
                error = "schedule"
            yield name, p["period_id"], p["schedule_open_utc"], p["schedule_close_utc"], p["observed_start_utc"], end, status, error


def _zip_rows(path: str) -> Iterator[dict]:
    with zipfile.ZipFile(path) as z:
        names = members(z)
        if "manifest.json" not in names or "ticks.csv" not in names:
            raise RecordingError("manifest.json or ticks.csv is missing")
        if bad := verify_checksums(z, names):
            raise RecordingError(f"checksum of {bad[0]}")
        manifest = json.loads(z.read("manifest.json"))
        rows = 0
        with z.open("ticks.csv") as f:
            for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")):
                rows += 1
                yield {k: v for k, v in r.items() if k is not None}
        if isinstance(manifest.get("row_count"), int) and manifest["row_count"] != rows:
            raise RecordingError("row_count of the manifest differs")


def _private(path: str, to: str) -> str:
    """A copy of a database as of one moment, even while it is written, so that nothing is written beside the source."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as source, closing(sqlite3.connect(os.path.join(to, "db"))) as copy:
        source.backup(copy)
    return os.path.join(to, "db")


def _sqlite_rows(path: str) -> Iterator[dict]:
    with tempfile.TemporaryDirectory() as t, closing(sqlite3.connect(_private(path, t))) as c:
        c.row_factory = sqlite3.Row
        have = {r["name"] for r in c.execute("pragma table_info(ticks)")}
        if missing := [x for x in TICK_COLUMNS[:5] if x not in have]:
            raise RecordingError(f"column {missing[0]} is missing")
        for r in c.execute("select * from ticks order by sequence"):
            yield dict(r)


def _paths(options: dict) -> list[str]:
    path = options["path"]
    found = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    return [p for p in found if os.path.isfile(p) and not p.endswith(("-wal", "-shm", "-journal"))]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordingSource(DataSource):
    """Option path: a file, a glob or a folder read recursively."""

    @classmethod
    def name(cls) -> str:
        return "tick_recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RecordingReader(self.options)


class _RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _paths(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.files]

    rows = staticmethod(read_recording)

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        try:
            yield from self.rows(partition.path)
        except (RecordingError, zipfile.BadZipFile, sqlite3.Error) as e:
            raise RecordingError(f"{os.path.basename(partition.path)}: {e}") from e  # which of many files it was


class InfoSource(RecordingSource):
    """One row of metadata per file."""

    rows, columns = read_info, INFO

    @classmethod
    def name(cls) -> str:
        return "recording_info"

    def schema(self) -> str:
        return type(self).columns

    def reader(self, schema) -> DataSourceReader:
        r = _RecordingReader(self.options)
        r.rows = type(self).rows
        return r


class EventSource(InfoSource):
    """The events of every file."""

    rows, columns = read_events, EVENTS

    @classmethod
    def name(cls) -> str:
        return "recording_events"


class PeriodSource(InfoSource):
    """The scheduled periods of every file."""

    rows, columns = read_periods, PERIODS

    @classmethod
    def name(cls) -> str:
        return "recording_periods"


class SqliteSource(DataSource):
    """Options path (file, glob or folder) and dbtable. Columns: the union over the files, as text, plus source_file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        names: dict[str, None] = {}
        for p in _paths(self.options):
            with tempfile.TemporaryDirectory() as t, closing(sqlite3.connect(_private(p, t))) as c:
                names.update(dict.fromkeys(r[1] for r in c.execute(f"pragma table_info({quoted(self.options['dbtable'])})")))
        return ", ".join([*(f"`{n}` string" for n in names), "source_file string"])

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, [f.name for f in schema.fields])


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.files, self.table, self.columns = _paths(options), options["dbtable"], columns
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            op = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}.get(type(f))
            if op and len(f.attribute) == 1 and isinstance(f.value, str) and f.attribute[0] != "source_file":
                self.where.append((f.attribute[0], op, f.value))
            yield f  # Spark checks it again: a file may lack the column

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        with tempfile.TemporaryDirectory() as t, closing(sqlite3.connect(_private(partition.path, t))) as c:
            have = [r[1] for r in c.execute(f"pragma table_info({quoted(self.table)})")]
            if not have:
                return
            want = [n for n in self.columns if n in have]
            cond = [(n, op, v) for n, op, v in self.where if n in have]
            sql = f"select {', '.join(f'cast({quoted(n)} as text)' for n in want) or 'null'} from {quoted(self.table)}"
            if cond:
                sql += " where " + " and ".join(f"cast({quoted(n)} as text) {op} ?" for n, op, _ in cond)
            name = os.path.basename(partition.path)
            for r in c.execute(sql, [v for *_, v in cond]):
                got = dict(zip(want, r))
                yield tuple(name if n == "source_file" else got.get(n) for n in self.columns)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    from ..util import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RecordingSource, InfoSource, EventSource, PeriodSource, SqliteSource):
        spark.dataSource.register(source)




def row_hash(row: dict) -> str:
    """SHA-256 of a row's canonical JSON."""
    return hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chain_hashes(hashes: Iterator[str], start: str = "") -> Iterator[str]:
    """h_i = SHA-256(h_(i-1) + r_i). A chain is sequential by nature; one file is one chain, so files are verified side by side."""
    link = start
    for r in hashes:
        link = hashlib.sha256((link + r).encode()).hexdigest()
        yield link


def verify_chain(path: str) -> list[str]:
    """What is wrong with a database's tick hashes: rows that do not match their record_hash, the first broken chain link,
    a break in the sequence. Databases without the hash columns have nothing to verify."""
    found: list[str] = []
    with tempfile.TemporaryDirectory() as t, closing(sqlite3.connect(_private(path, t))) as c:
        c.row_factory = sqlite3.Row
        have = {r["name"] for r in c.execute("pragma table_info(ticks)")}
        if not {"record_hash", "chain_hash"} <= have:
            return found
        rows = [dict(r) for r in c.execute("select * from ticks order by sequence")]
    want = [{k: v for k, v in r.items() if k not in ("record_hash", "chain_hash")} for r in rows]
    found += [f"record {r['sequence']}" for r, w in zip(rows, want) if r["record_hash"] != row_hash(w)]
    broken = next((r["sequence"] for r, h in zip(rows, chain_hashes(iter([r["record_hash"] for r in rows]))) if r["chain_hash"] != h), None)
    found += [f"chain {broken}"] if broken is not None else []
    gap = next((b["sequence"] for a, b in zip(rows, rows[1:]) if b["sequence"] != a["sequence"] + 1), None)
    return found + ([f"sequence {gap}"] if gap is not None else [])


def verify_recordings(spark: SparkSession, path: str):
    """(path, problem): the problems of every database under a path, one file a task."""
    import pandas as pd

    from ..util import ship

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tickloom.sources.recording import verify_chain

        for b in batches:
            yield pd.DataFrame([(p, x) for p in b.path for x in verify_chain(p)], columns=["path", "problem"])

    files = _paths({"path": path})
    return spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files))).mapInPandas(run, "path string, problem string")
