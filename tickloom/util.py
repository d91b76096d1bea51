"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes on disk, that an operator may broadcast.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[Callable[[], None]] = []


@atexit.register
def release() -> None:
    """Removes the tables written so far. For a driver that runs one query after the other: once a query's result is
    written, its intermediate tables are of no use, and DataFrames that read them can no longer run."""
    while _written:
        _written.pop()()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a parquet table in the shared folder and read it back.

    The files survive the loss of any executor; they are removed by ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the session is gone
            pass

    _written.append(drop)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session's settings of ``conf`` for what is started inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan: of a written table the bytes of its files, of a plan over files a bound that joins
    only widen. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its plan's size is at most ``limit`` (BROADCAST_BYTES) bytes, else as it is (a
    shuffle join). ``df`` should be a written table: its size is then exact."""
    return F.broadcast(df) if plan_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def iso_micros(c: Column) -> Column:
    """Epoch microseconds of an ISO-8601 text; no zone means UTC, anything else gives null.

    Independent of the session's time zone. Extended and basic spellings are read, with ``T`` or a
    blank, an optional fraction (cut to microseconds) and a zone of Z, +HH, +HHMM or +HH:MM.
    """
    t = F.upper(F.trim(c))
    pat = r"^(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)? ?(Z|UTC|[+-]\d{2}(?::?\d{2})?)?$"
    # One match brings the groups into one order, behind a mark that the text itself must not hold; they are taken apart once.
    groups = F.split(F.when(~t.contains("\u0001"), F.regexp_replace(t, pat, "\u0001|$1-$2-$3|$4|$5|$6|$7|$8")), "\\|")

    def micros_of(g: Column) -> Column:
        num = lambda i: F.when(g[i] == "", 0).otherwise(g[i].try_cast("long"))
        day = F.try_to_date(g[1], "yyyy-MM-dd")
        zone = F.regexp_replace(g[6], ":", "")
        off = F.when(
            F.substring(zone, 1, 1).isin("+", "-"),
            (F.substring(zone, 2, 2).try_cast("long") * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("long"), F.lit(0))) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1),
        ).otherwise(0)
        secs = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + num(2) * 3600 + num(3) * 60 + num(4) - off * 60
        frac = F.when(g[5] == "", 0).otherwise(F.rpad(F.substring(g[5], 1, 6), 6, "0").try_cast("long"))
        return F.when(day.isNotNull() & (num(2) < 24) & (num(3) < 60) & (num(4) < 60), secs * 1_000_000 + frac)

    return F.transform(F.when((F.size(groups) == 7) & (groups[0] == "\u0001"), F.array(groups)), micros_of)[0]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; needed before any Python function runs there."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tickloom-code-"))
    copy = to / "src" / root.name
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(to / root.name), "zip", to / "src"))
    sc._tickloom_shipped = True
