"""Deterministic files from small results, and their publication.

These are for reports: results whose rows a caller has already reduced. Bulk results go through Spark's writers.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
import os
import shutil
import tempfile
import time
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(x: object) -> object:
    """The value as JSON knows it; NaN and infinities become null, keys text."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict(True))
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    return x if x is None or isinstance(x, (bool, int, str)) else x.isoformat() if hasattr(x, "isoformat") else str(x)


def canonical_json(x: object) -> bytes:
    """One byte string for equal values: sorted keys, no spaces, UTF-8."""
    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def fingerprint(parts: Mapping[str, object]) -> str:
    """Identity of an analysis: of its inputs' hashes and parameters, never of paths or times."""
    return hashlib.sha256(canonical_json(parts)).hexdigest()


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order and partitioning: sums of row hashes, combined before the shuffle."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("h", 32)).alias("a"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(canonical_json([*sorted(df.columns), r.n, r.a, r.b, r.x])).hexdigest()


def write_json(path: Path, x: object) -> None:
    path.write_text(json.dumps(plain(x), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")


def _cell(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return "'" + x if x.lstrip()[:1] in ("=", "+", "-", "@") and x.strip() else x
    v = plain(x)
    return "" if v is None else str(v) if isinstance(v, (int, float)) else json.dumps(v, sort_keys=True, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def write_csv(path: Path, rows: Iterable[Mapping[str, object]]) -> None:
    """All keys of all rows in order of appearance; nested values as JSON; texts that look like formulas made harmless."""
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
    names = list(dict.fromkeys(k for r in rows for k in r))
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(names)
        w.writerows([_cell(r.get(n)) for n in names] for r in rows)


def tree_hashes(root: Path) -> dict[str, str]:
    """SHA-256 of every file below a folder by its relative path."""
    return {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*")) if p.is_file()}


def publish(bundle: Mapping[str, object], parent: Path, prefix: str, identity: str, attempts: int = 5) -> Path:
    """Writes the files of a bundle (rows as CSV, anything else as JSON), their SHA256SUMS, and moves the finished folder
    into place in one step. An equal folder that is there already is kept; a different one is an error."""
    parent.mkdir(parents=True, exist_ok=True)
    target = parent / f"{prefix}_{identity[:16]}"
    work = Path(tempfile.mkdtemp(prefix=".making-", dir=parent))
    try:
        for name, x in sorted(bundle.items()):
            write_csv(work / name, x) if name.endswith(".csv") else write_json(work / name, x)
        sums = tree_hashes(work)
        (work / "SHA256SUMS").write_text("".join(f"{h}  {n}\n" for n, h in sums.items()))
        for n in range(attempts):
            if target.exists():
                if tree_hashes(target) != tree_hashes(work):
                    raise FileExistsError(f"{target} holds another result")
                return target
            try:
                os.rename(work, target)
                return target
            except OSError:
                if n == attempts - 1:
                    raise
                time.sleep(0.05 * 2**n)
        return target
    finally:
        shutil.rmtree(work, ignore_errors=True)
