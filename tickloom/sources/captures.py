"""Fill-centred capture archives: inventory and points, from binary files and Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import ship
from .recording import RecordingError, members

POINTS = "file string, row_no int, captured_at_utc string, ticker string, cycle_id string, stage string, price double, atr_pct double, fresh boolean, error string"
INVENTORY = "file string, event_type string, ticker string, cycle_id string, order_ref string, event_time_utc string, row_count int, error string"


def _number(x: object) -> float | None:
    try:
        v = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return v if v == v and abs(v) != float("inf") else None


def _first(*xs: object) -> float | None:
    return next((v for v in map(_number, xs) if v is not None and v > 0), None)


def _fresh(row: dict) -> bool:
    for key in ("strategy_price_usable", "api_data_received_in_latest_read", "market_data_update_consumed"):
        if row.get(key) is not None and row.get(key) != "":
            return str(row[key]).strip().lower() in ("1", "true", "yes")
    return True


def _rows(z: zipfile.ZipFile, names: dict) -> Iterator[tuple[int, dict | None, str | None]]:
    """JSON lines if any is usable, else the CSV."""
    usable = False
    if "market_data.jsonl" in names:
        with z.open("market_data.jsonl") as f:
            for n, line in enumerate(io.TextIOWrapper(f, "utf-8", errors="replace"), 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                    if not isinstance(row, dict):
                        raise ValueError("no object")
                    usable = True
                    yield n, row, None
                except ValueError as e:
                    yield n, None, f"json: {e}"[:200]
    if not usable and "market_data.csv" in names:
        with z.open("market_data.csv") as f:
            for n, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")), 2):
                yield n, {k: v for k, v in row.items() if k}, None


def read_points(path: str, content: bytes) -> list[tuple]:
    """Rows of POINTS from one archive; an unreadable archive is one row with its error."""
    out: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n, row, error in _rows(z, members(z)):
                if row is None:
                    out.append((path, n, None, None, None, None, None, None, None, error))
                    continue
                fields = row.get("fields") if isinstance(row.get("fields"), dict) else {}
                price = _first(row.get("price"), fields.get("last"), fields.get("marketPrice"))
                error = None if price is not None else "price"
                out.append((path, n, row.get("captured_at_utc"), row.get("ticker"), str(row.get("cycle_id") or "") or None, row.get("stage"), price, _number(row.get("atr_pct")), _fresh(row), error))
    except (zipfile.BadZipFile, RecordingError, OSError) as e:
        out.append((path, 0, None, None, None, None, None, None, None, f"archive: {e}"[:200]))
    return out


def read_inventory(path: str, content: bytes) -> tuple:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = members(z)
            m = json.loads(z.read("manifest.json")) if "manifest.json" in names else {}
            e = json.loads(z.read("event.json")) if "event.json" in names else {}
            cycle = e.get("cycle") or {}
            return (path, e.get("event_type") or m.get("event_type"), m.get("ticker") or cycle.get("ticker"), m.get("cycle_id") or cycle.get("id"), m.get("order_ref") or e.get("order_ref"), e.get("event_time_utc"), m.get("rows"), None if m else "manifest")
    except (zipfile.BadZipFile, RecordingError, OSError, ValueError, KeyError) as x:
        return (path, None, None, None, None, None, None, f"archive: {x}"[:200])


def _files(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).select("path", "content")


def points(spark: SparkSession, root: str) -> DataFrame:
    """All points of all archives under a folder, bad rows with their reason; exact repeats once; stale rows only where an
    archive has no fresh one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tickloom.sources.captures import POINTS, read_points

        names = [c.split()[0] for c in POINTS.split(", ")]
        for b in batches:
            for p, c in zip(b.path, b.content):
                yield pd.DataFrame(read_points(p, c), columns=names)

    from pyspark.sql import Window

    d = _files(spark, root).mapInPandas(run, POINTS)
    good = d.where("error is null").dropDuplicates(["file", "captured_at_utc", "ticker", "cycle_id", "stage", "price", "atr_pct", "fresh"])
    any_fresh = F.max("fresh").over(Window.partitionBy("file"))
    return good.withColumn("_f", any_fresh).where("fresh or not _f").drop("_f").unionByName(d.where("error is not null"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per archive, readable or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tickloom.sources.captures import INVENTORY, read_inventory

        names = [c.split()[0] for c in INVENTORY.split(", ")]
        for b in batches:
            yield pd.DataFrame([read_inventory(p, c) for p, c in zip(b.path, b.content)], columns=names)

    return _files(spark, root).mapInPandas(run, INVENTORY)
