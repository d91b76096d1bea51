"""Load the rows that parse, set apart those that do not, with the reason.

Strict load plus anti-join: the strict loader keeps the offset of every record and yields only rows whose
structure and values conform; the raw offsets minus the loaded ones are the rejects, and only these are
diagnosed. All checks are JVM expressions without recursion, so that long lines cannot exhaust a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header of a capture file, and the names a changed_fields list may hold.
CAPTURE_COLUMNS = ["captured_at_utc", "monotonic_ts", "ticker", "cycle_id", "cycle_number", "stage", "price", "source", "atr_pct", "changed_fields", "note"]
CHANGED_FIELDS = ["bid", "ask", "last", "bid_size", "ask_size", "last_size", "volume", "mark_price", "open", "high", "low", "close"]

_STAMP = r"^\d{4}-\d{2}-\d{2}[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"
_NUMBER = r"^\+?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def skeleton(line: Column) -> Column:
    """The line with every quoted chunk shrunk to U+0001. Doubled quotes make two neighbouring chunks of one field."""
    return F.regexp_replace(F.translate(line, "\u0001", " "), '"[^"]*+"', "\u0001")


def sound_quotes(skel: Column) -> Column:
    """True if no quote is left open or stands inside an unquoted field, and chunks fill their field alone."""
    return ~skel.contains('"') & ~skel.rlike("[^,\u0001]\u0001|\u0001[^,\u0001]")


def stamp_ok(c: Column) -> Column:
    return c.rlike(_STAMP) & (F.substring(c, 1, 4) != "0000") & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull()


def price_ok(c: Column) -> Column:
    v = F.when(c.rlike(_NUMBER), c).try_cast("double")
    return F.coalesce((v > 0) & (v < float("inf")), F.lit(False))


def changed_ok(c: Column) -> Column:
    names = "|".join(CHANGED_FIELDS)
    return (F.trim(c) == "") | ~F.exists(F.split(c, ","), lambda x: ~x.rlike(rf"^ *(?:{names}) *$"))


def _fields(line: Column) -> Column:
    schema = ", ".join(f"c{i} string" for i in range(len(CAPTURE_COLUMNS)))
    return F.from_csv(line, schema, {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "nullValue": "\u0001", "emptyValue": "", "maxCharsPerColumn": "-1", "comment": "\u0000"})


def _checked(lines: DataFrame) -> DataFrame:
    """Adds _skel, and _f, the parsed fields of lines of sound structure."""
    at = {n: i for i, n in enumerate(CAPTURE_COLUMNS)}
    d = lines.withColumn("_skel", skeleton(F.col("_line")))
    d = d.withColumn("_quotes", sound_quotes(F.col("_skel"))).withColumn("_count", F.length("_skel") - F.length(F.replace("_skel", F.lit(","), F.lit(""))) + 1)
    d = d.withColumn("_f", F.when(F.col("_quotes") & (F.col("_count") == len(CAPTURE_COLUMNS)), _fields(F.col("_line"))))
    for n in ("captured_at_utc", "price", "changed_fields"):
        d = d.withColumn(f"_{n}", F.coalesce(F.col(f"_f.c{at[n]}"), F.lit("")))
    return d


def _raw(lines: DataFrame) -> DataFrame:
    """The data lines with their offsets; a null text counts as an empty line."""
    return lines.where(~F.col("line_no").eqNullSafe(F.lit(1))).select(
        F.col("line_id").alias("_id"), F.col("file_name").alias("_file"), F.col("line_no").alias("_no"), F.coalesce("line_text", F.lit("")).alias("_line")
    )


def load_strict(lines: DataFrame) -> DataFrame:
    """The conforming lines as typed price points, with their offsets (line_id, file_name, line_no)."""
    d = _checked(_raw(lines)).where(F.col("_f").isNotNull() & stamp_ok(F.col("_captured_at_utc")) & price_ok(F.col("_price")) & changed_ok(F.col("_changed_fields")))
    names = F.filter(F.transform(F.split("_changed_fields", ","), lambda x: F.trim(x)), lambda x: x != "")
    text = [F.nullif(F.col(f"_f.c{i}"), F.lit("")).alias(n) for i, n in enumerate(CAPTURE_COLUMNS) if n in ("ticker", "cycle_id", "stage", "source", "note")]
    stamp = F.when(F.col("_captured_at_utc").rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), F.col("_captured_at_utc")).otherwise(F.concat("_captured_at_utc", F.lit("Z")))
    return d.select(
        F.col("_id").alias("line_id"), F.col("_file").alias("file_name"), F.col("_no").alias("line_no"), F.to_timestamp(stamp).alias("captured_at_utc"),
        F.col("_price").cast("double").alias("price"), names.alias("changed_fields"), F.col("_f.c1").try_cast("double").alias("monotonic_ts"),
        F.col("_f.c4").try_cast("long").alias("cycle_number"), F.col("_f.c8").try_cast("double").alias("atr_pct"), *text,
        F.xxhash64("_line").alias("_hash"),
    )


def capture_points(lines: DataFrame) -> DataFrame:
    """Price points of all lines that parse."""
    return load_strict(lines).drop("_hash")


def capture_rejects(lines: DataFrame) -> DataFrame:
    """Rows (line_id, file_name, line_no, line_text, reason) of the lines that do not load.

    reason is the first that holds of quoting, column_count, captured_at_utc, price, changed_fields. Header
    lines (line_no 1) are no records; a line with a null number is. A null text is an empty line
    (column_count). Offsets are matched null-safe and together with the text, so null or repeated ids lose
    no row: repeated lines come out as often as they stand. Extra columns are ignored.
    """
    raw, loaded = _raw(lines), load_strict(lines).select("line_id", "file_name", "line_no", "_hash")
    raw = raw.withColumn("_h", F.xxhash64("_line"))
    rest = raw.join(
        loaded,
        raw["_id"].eqNullSafe(loaded["line_id"]) & raw["_file"].eqNullSafe(loaded["file_name"]) & raw["_no"].eqNullSafe(loaded["line_no"]) & (raw["_h"] == loaded["_hash"]),
        "left_anti",
    )
    reason = (
        F.when(~F.col("_quotes"), "quoting")
        .when(F.col("_count") != len(CAPTURE_COLUMNS), "column_count")
        .when(~stamp_ok(F.col("_captured_at_utc")), "captured_at_utc")
        .when(~price_ok(F.col("_price")), "price")
        .otherwise("changed_fields")
    )
    return _checked(rest).select(F.col("_id").alias("line_id"), F.col("_file").alias("file_name"), F.col("_no").alias("line_no"), F.col("_line").alias("line_text"), reason.alias("reason"))
