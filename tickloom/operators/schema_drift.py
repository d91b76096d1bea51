"""One table out of files whose fields drift, with a report of every change.

Every file's columns are profiled (type class, share of nulls, a bottom-k sketch of the values, the name).
Fields that are gone and fields that are new between two versions form a bipartite graph: an edge joins two that have
sketch values in common or agree on shared records, and its weight is made of that agreement, the sketches, the types
and the names; an optimal matching finds the renames. Shared records decide where there are any, the profiles alone
where there are none. Chains of renames then map every spelling to one unified column, bot by bot.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, ship, small

#: Least share of shared records whose values agree for a pair of fields to be one renamed field.
AGREE = 0.8
#: Values kept in a column's sketch.
SKETCH = 16
#: Least share of common sketch values for a rename between fields that no shared record carries both of.
ALIKE = 0.5


def _number(t: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.regexp_replace(t, "%$", "")), ",(?=[0-9]{3})", "").try_cast("double")


def _stamp(t: Column) -> Column:
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), t).try_cast("timestamp")


def _truth(t: Column) -> Column:
    return F.when(F.lower(t).isin("true", "yes"), True).when(F.lower(t).isin("false", "no"), False)


def normal_value(value: Column, kind: Column) -> Column:
    """One notation for the values of a field, whatever its type: numbers as doubles, times as epoch milliseconds, truth values as 1 and 0."""
    t = F.trim(value)
    truth = _truth(t).cast("double")
    v = F.when(kind == "number", t.try_cast("double")).when(kind == "boolean", truth).otherwise(F.coalesce(_number(t), truth, F.unix_millis(_stamp(t)).cast("double")))
    return F.coalesce(F.round(v, 9).cast("string"), F.lower(t))


def cells(exports: DataFrame) -> DataFrame:
    """(export_id, id, name, kind, raw, value): one row per record and field; raw is the value as it stands, value the
    one notation, which serves comparisons only. kind is text, number, boolean, or null for a null value."""
    v = exports.select("export_id", F.try_parse_json("row_json").alias("_v")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    x = v.select("export_id", F.try_variant_get("_v", "$.id", "string").alias("id"), "_v")
    x = x.lateralJoin(x.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("export_id", "id", F.col("key").alias("name"), F.col("value").alias("_x"))
    form = F.schema_of_variant("_x")
    kind = F.when(form == "VOID", None).when(form == "BOOLEAN", "boolean").when(form.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").otherwise("text")
    value = F.when(form == "VOID", None).otherwise(F.coalesce(F.expr("try_variant_get(_x, '$', 'string')"), F.to_json("_x")))
    x = x.select("export_id", "id", "name", kind.alias("kind"), value.alias("raw"))
    return x.withColumn("value", normal_value(F.col("raw"), F.col("kind")))


def versions(exports: DataFrame) -> DataFrame:
    """(export_id, bot_id, prior_id): each file and the same bot's file before it, by exported_at (ties: export_id). A bot's first file has null."""
    files = exports.where("export_id is not null").groupBy("export_id").agg(F.min(F.struct("bot_id", "exported_at")).alias("f")).select("export_id", "f.*")
    return files.select("export_id", "bot_id", F.lag("export_id").over(Window.partitionBy("bot_id").orderBy("exported_at", "export_id")).alias("prior_id"))


def profiles(cell: DataFrame) -> DataFrame:
    """(export_id, name, kind, n, nulls, sketch) per field of a file; kind is the most frequent one (ties: the first in the alphabet)."""
    # Most frequent kind: one aggregate per (file, field), nothing is collected.
    kinds = [F.count_if(F.col("kind") == k).alias(k[0]) for k in ("boolean", "number", "text")]
    top = F.greatest("b", "n", "t")
    kind = F.when(top == 0, None).when(F.col("b") == top, "boolean").when(F.col("n") == top, "number").otherwise("text")
    # The smallest hash of each of SKETCH buckets: a sketch of bounded size that merges by the minimum.
    h = F.when(F.col("value").isNotNull(), F.xxhash64("value"))
    one = [F.min(F.when(F.pmod(h, F.lit(SKETCH)) == i, h)).alias(f"_h{i}") for i in range(SKETCH)]
    d = cell.groupBy("export_id", "name").agg(*kinds, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), *one)
    return d.select("export_id", "name", kind.alias("kind"), F.col("rows"), "nulls", F.array_compact(F.array(*[f"_h{i}" for i in range(SKETCH)])).alias("sketch"))


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of greatest total weight; pairs of weight 0 are left out. Shortest augmenting paths, O(n^3)."""
    rows, cols = len(weight), max((len(r) for r in weight), default=0)
    n = max(rows, cols)
    cost = [[-(weight[i][j] if i < rows and j < cols else 0.0) for j in range(n)] for i in range(n)]
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            seen[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    found = [(match[j] - 1, j - 1) for j in range(1, n + 1) if match[j]]
    return sorted((i, j) for i, j in found if i < rows and j < cols and weight[i][j] > 0)


def _match(edges: pd.DataFrame) -> pd.DataFrame:
    old, new = sorted(set(edges.prior_name)), sorted(set(edges.name))
    w = [[0.0] * len(new) for _ in old]
    for a, b, x in zip(edges.prior_name, edges.name, edges.weight):
        w[old.index(a)][new.index(b)] = x
    pairs = best_matching(w)
    return pd.DataFrame({"export_id": [edges.export_id.iloc[0]] * len(pairs), "name": [new[j] for _, j in pairs], "prior_name": [old[i] for i, _ in pairs]})


def _changes(exports: DataFrame, cell: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields of each version beside those of the version before, renames)."""
    v = materialize(versions(exports))
    prof = materialize(profiles(cell))
    later = prof.join(small(v.where("prior_id is not null")), "export_id").select("export_id", "name", F.lit(1).alias("now"), "kind", "sketch", "rows", "nulls")
    after = v.where("prior_id is not null").select(F.col("prior_id"), F.col("export_id").alias("_next"))
    before = prof.join(small(after), F.col("export_id") == F.col("prior_id")).select(F.col("_next").alias("export_id"), "name", F.lit(0).alias("now"), "kind", "sketch", "rows", "nulls")
    pick = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c)))
    both = later.unionByName(before).groupBy("export_id", "name").agg(
        F.max(F.col("now") == 1).alias("is_now"), F.max(F.col("now") == 0).alias("was"), pick("kind", 1).alias("kind"), pick("kind", 0).alias("prior_kind"),
        F.first(F.when(F.col("now") == 1, F.col("sketch")), True).alias("sketch"), F.first(F.when(F.col("now") == 0, F.col("sketch")), True).alias("prior_sketch"),
    )
    both = materialize(both)
    lone = both.where("is_now <> was").select("export_id", "name", "is_now", F.coalesce("sketch", "prior_sketch").alias("sketch"), F.coalesce("kind", "prior_kind").alias("kind"))
    # Only versions with fields on both sides can hold a rename.
    open_ = lone.groupBy("export_id").agg(F.max("is_now").alias("x"), F.min("is_now").alias("y")).where("x and not y").select("export_id")
    lone = materialize(lone.join(open_, "export_id", "left_semi"))
    # Values of the candidate fields alone, keyed by the later file.
    side = lone.join(v, "export_id").select("export_id", "name", "is_now", F.when(F.col("is_now"), F.col("export_id")).otherwise(F.col("prior_id")).alias("_file"))
    c = cell.where("id is not null and value is not null").select(F.col("export_id").alias("_file"), "id", "name", F.col("value").alias("_val"))
    c = c.join(small(materialize(side)), ["_file", "name"]).select("export_id", "id", "name", "is_now", "_val").distinct()
    a = c.where("not is_now").select("export_id", "id", F.col("name").alias("prior_name"), F.col("_val").alias("_old"))
    b = c.where("is_now").select("export_id", "id", "name", F.col("_val").alias("_new"))
    same = materialize(a.join(b, ["export_id", "id"]).groupBy("export_id", "prior_name", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_old") == F.col("_new")).alias("eq"), F.count_distinct(F.when(F.col("_old") == F.col("_new"), F.col("_old"))).alias("kinds")))
    # Candidates: pairs with a sketch value in common, and pairs that meet in shared records. Neither makes all pairs.
    hashes = lone.select("export_id", "name", "is_now", F.explode("sketch").alias("_h"))
    met = hashes.where("is_now").join(hashes.where("not is_now").select("export_id", "_h", F.col("name").alias("prior_name")), ["export_id", "_h"])
    pairs = met.select("export_id", "prior_name", "name").unionByName(same.select("export_id", "prior_name", "name")).distinct()
    sk = lone.where("is_now").select("export_id", "name", F.col("sketch").alias("_a"), F.col("kind").alias("_ka"))
    ps = lone.where("not is_now").select("export_id", F.col("name").alias("prior_name"), F.col("sketch").alias("_b"), F.col("kind").alias("_kb"))
    common = F.size(F.array_intersect("_a", "_b"))
    alike = F.coalesce(common / F.greatest(F.size(F.array_union("_a", "_b")), F.lit(1)), F.lit(0.0))
    flat = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "")
    name = 1 - F.levenshtein(flat("name"), flat("prior_name")) / F.greatest(F.length("name"), F.length("prior_name"), F.lit(1))
    edges = pairs.join(same, ["export_id", "prior_name", "name"], "left").join(sk, ["export_id", "name"]).join(ps, ["export_id", "prior_name"])
    # With shared records: they must agree, in several different values (flags and constants agree by chance) or under
    # an alike name. Without: the profiles must agree so.
    shared = (F.col("eq") >= AGREE * F.col("n")) & ((F.col("kinds") >= 3) | (name >= 0.4))
    profiled = (alike >= ALIKE) & ((common >= 4) | (name >= 0.6))
    # Agreement counts most; more different agreeing values, alike sketches, types and names decide between equals.
    agree = F.coalesce(F.col("eq") / F.col("n"), alike)
    several = 0.2 * F.least(F.coalesce(F.col("kinds"), common), F.lit(8)) / 8
    weight = agree + several + 0.1 * alike + 0.2 * name + F.when(F.col("_ka") == F.col("_kb"), 0.05).otherwise(0.0)
    edges = edges.where(F.when(F.col("n") > 0, shared).otherwise(profiled)).select("export_id", "prior_name", "name", weight.alias("weight"))
    ship(exports.sparkSession)
    renames = edges.groupBy("export_id").applyInPandas(_match, "export_id long, name string, prior_name string")
    return both, materialize(renames)


def drift_report(exports: DataFrame) -> DataFrame:
    """Rows (export_id, change, field_name, prior_name): every change of a file against the bot's file before it.

    change is renamed, added, removed or retyped; prior_name is empty unless renamed. A field is in a file if
    any record has its key; its type is its most frequent type class, nulls aside, and a field without values
    is never retyped. Repeated records, key order and records that are no JSON object change nothing; files
    without a file before them, and an empty table, report nothing.
    """
    both, renames = _changes(exports, materialize(cells(exports.dropDuplicates(["export_id", "row_json"])).drop("raw")))
    kept = both.where("is_now and was and kind <> prior_kind").select("export_id", F.lit("retyped").alias("change"), F.col("name").alias("field_name"), F.lit("").alias("prior_name"))
    ren = renames.select("export_id", F.lit("renamed").alias("change"), F.col("name").alias("field_name"), "prior_name")
    new = both.where("is_now and not was").join(renames, ["export_id", "name"], "left_anti").select("export_id", F.lit("added").alias("change"), F.col("name").alias("field_name"), F.lit("").alias("prior_name"))
    gone = both.where("was and not is_now").join(renames.select("export_id", F.col("prior_name").alias("name")), ["export_id", "name"], "left_anti")
    gone = gone.select("export_id", F.lit("removed").alias("change"), F.col("name").alias("field_name"), F.lit("").alias("prior_name"))
    kinds = both.select("export_id", "name", "kind", "prior_kind")
    both_kinds = renames.join(kinds.select("export_id", "name", "kind"), ["export_id", "name"]).join(kinds.select("export_id", F.col("name").alias("prior_name"), "prior_kind"), ["export_id", "prior_name"])
    retyped = both_kinds.where("kind <> prior_kind").select("export_id", F.lit("retyped").alias("change"), F.col("name").alias("field_name"), F.lit("").alias("prior_name"))
    return kept.unionByName(ren).unionByName(new).unionByName(gone).unionByName(retyped)


def canonical_names(renames: DataFrame, files: dict[str, int]) -> dict[str, str]:
    """Each renamed spelling's unified column: of the spellings that renames connect, the one in most files (ties: the first in the alphabet).

    Only distinct pairs of field names reach the driver; their number is bounded by the vocabulary of field
    names, not by files or records.
    """
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in renames.select("prior_name", "name").distinct().collect():
        root[find(r.name)] = find(r.prior_name)
    groups: dict[str, list[str]] = {}
    for x in list(root):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g, key=lambda y: (-files.get(y, 0), y)) for g in groups.values() for x in g}


def unified_type(c: Counter) -> str:
    """The one type that holds every value of a field, from the counts of its values in each form; string where none does."""
    if c["stamp"] and c["stamp"] + c["epoch"] == c["n"]:
        return "timestamp"
    if c["word"] and (c["boolean"] or c["number"]) and c["word"] + c["bit"] == c["n"]:
        return "boolean"
    if c["number"] and c["numeric"] == c["n"]:
        return "bigint" if c["whole"] == c["n"] else "double"
    return "string"  # also texts that merely look like numbers: their zeros and signs belong to them


def _cast(raw: Column, to: str) -> Column:
    t = F.trim(raw)
    if to == "timestamp":
        return F.coalesce(_stamp(t), F.timestamp_millis(t.try_cast("bigint")))
    if to == "boolean":
        return F.coalesce(_truth(t), t.try_cast("double") == 1)
    return t.try_cast("bigint") if to == "bigint" else _number(t) if to == "double" else raw


def _columns(cell: DataFrame, exports: DataFrame, names: dict[str, str]) -> DataFrame:
    """The cells with _col, the unified column of each. Where any of a bot's files holds two spellings of one column
    beside each other, they are two fields of that bot, which keep their own names."""
    spark = cell.sparkSession
    if not names:
        return cell.withColumn("_col", F.col("name"))
    # A row per spelling: bounded by the vocabulary of field names.
    to = F.broadcast(spark.createDataFrame(sorted(names.items()), "name string, _to string"))
    cell = cell.join(to, "name", "left").join(small(materialize(versions(exports).select("export_id", "bot_id"))), "export_id", "left")
    beside = cell.where("_to is not null").groupBy("export_id", "bot_id", "_to").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    beside = materialize(beside.select(F.col("bot_id").alias("_bot"), F.col("_to").alias("_two")).distinct())
    cell = cell.join(small(beside), F.col("bot_id").eqNullSafe(F.col("_bot")) & (F.col("_to") == F.col("_two")), "left")
    return cell.withColumn("_col", F.when(F.col("_to").isNotNull() & F.col("_two").isNull(), F.col("_to")).otherwise(F.col("name"))).drop("bot_id", "_to", "_bot", "_two")


def unified_cycles(exports: DataFrame) -> DataFrame:
    """One row (export_id, id, one text column per unified field, typed) per record of every file.

    The text columns hold the values as they stand in the files; the struct typed has the same fields, each cast to
    the one type that all its values fit: timestamp (also from epoch milliseconds), boolean (also from 1 and 0),
    bigint, double (also from percentages), else string. A field called typed moves the struct to _typed.
    A field renamed in any bot's files has one column for all, except for bots with both spellings in one file.
    Records without an id, and what is no JSON object, are left out; repeated records count once (of
    contradicting ones the largest value of each field in the one notation stands).
    """
    exports = exports.dropDuplicates(["export_id", "row_json"])
    cell = materialize(cells(exports))
    _, renames = _changes(exports, cell.drop("raw"))
    files = {r.name: r.files for r in cell.where("name is not null").groupBy("name").agg(F.count_distinct("export_id").alias("files")).collect()}
    cell = materialize(_columns(cell, exports, canonical_names(renames, files)))
    t = F.trim("raw")
    forms = {
        "n": t.isNotNull(), "number": F.col("kind") == "number", "boolean": F.col("kind") == "boolean", "numeric": _number(t).isNotNull(), "whole": t.rlike("^-?[0-9]{1,18}$"),
        "epoch": t.rlike("^-?[0-9]{1,14}$"), "stamp": _stamp(t).isNotNull(), "word": _truth(t).isNotNull(), "bit": t.try_cast("double").isin(0.0, 1.0),
    }
    # A row per unified column: bounded by the vocabulary of field names.
    seen = cell.where("_col is not null").groupBy("_col").agg(*[F.count_if(c).alias(f"_{k}") for k, c in forms.items()]).collect()
    counts = {r["_col"]: Counter({k: r[f"_{k}"] for k in forms}) for r in seen}
    wide = sorted(set(counts) - {"id", "export_id"})
    rows = cell.where("id is not null").groupBy("export_id", "id")
    if not wide:
        return rows.agg(F.count(F.lit(1)).alias("records"))
    out = rows.agg(*[F.max(F.when((F.col("_col") == w) & F.col("raw").isNotNull(), F.struct("value", "raw")))["raw"].alias(w) for w in wide])
    name = "typed"
    while name in {w.lower() for w in wide}:
        name = f"_{name}"
    quoted = lambda w: F.col("`" + w.replace("`", "``") + "`")
    return out.withColumn(name, F.struct(*[_cast(quoted(w), unified_type(counts[w])).alias(w) for w in wide]))
