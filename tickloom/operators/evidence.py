"""Evidence out of matched records: samples with conflicts, supported costs, pairs against a control, selection stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_index


def clean_samples(rows: DataFrame, key: str, agree: dict[str, float], complete: list[str], tie: list[str]) -> DataFrame:
    """One row per key: of rows that agree - each column of ``agree`` within its tolerance, nulls aside - the most complete
    (most non-null of ``complete``; ties: the smallest ``tie``). Adds copies and conflict; a key in conflict keeps its row
    and is marked."""
    full = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in complete])
    apart = reduce(lambda a, b: a | b, [F.coalesce(F.max(c) - F.min(c) > tol, F.lit(False)) for c, tol in agree.items()])
    others = F.struct(*[c for c in rows.columns if c != key])
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(others, F.struct(-full, *tie)).alias("x"), F.count(F.lit(1)).alias("copies"), apart.alias("conflict"))
    return g.select(key, "x.*", "copies", "conflict")


def supported_cost(groups: DataFrame, minimum: int, floor: float) -> DataFrame:
    """Adds cost and source: the 75th percentile of the widest measure with ``minimum`` samples - both costs together, else
    slippage, else commission, else none - and never less than ``floor``. ``groups`` has n_total, n_slippage, n_commission
    and total, slippage, commission."""
    source = F.lit("none")
    for name in ("commission", "slippage", "total"):
        source = F.when(F.col(f"n_{name}") >= minimum, name).otherwise(source)
    g = groups.withColumn("source", source)
    best = F.when(F.col("source") == "total", F.col("total")).when(F.col("source") == "slippage", F.col("slippage")).when(F.col("source") == "commission", F.col("commission"))
    return g.withColumn("cost", F.greatest(F.lit(floor), best))


def pairs_with_control(rows: DataFrame, candidate: str, control: Column, keys: list[str], value: str, same: list[str]) -> DataFrame:
    """(candidate, keys, delta): each candidate's value less the control's under equal keys. Keys that stand more than once
    on either side, on one side only, or with another context (``same``, null-safe) make no pair."""
    once = rows.groupBy(candidate, *keys).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias(value), *[F.max(c).alias(c) for c in same]).where("_n = 1").drop("_n")
    base = once.where(control).select(*keys, F.col(value).alias("_base"), *[F.col(c).alias(f"_c_{c}") for c in same])
    j = once.where(~control).join(base, keys)
    for c in same:
        j = j.where(F.col(c).eqNullSafe(F.col(f"_c_{c}")))
    return j.select(candidate, *keys, (F.col(value) - F.col("_base")).alias("delta"))


def selection_stability(rows: DataFrame, group: str, candidate: str, unit: str, value: str) -> DataFrame:
    """Per group: the candidate with the greatest mean (ties: the smallest), the number of reruns, each without one unit, and
    the share of them that choose it again. A candidate left without values cannot be chosen. Totals less a unit's own:
    rows are candidates x units of a group."""
    own = rows.where(F.col(value).isNotNull()).groupBy(group, candidate, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = own.groupBy(group, candidate).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    pick = lambda mean: F.max_by(candidate, F.struct(F.round(mean, 9), -F.col(candidate)))
    full = total.groupBy(group).agg(pick(F.col("_all_s") / F.col("_all_n")).alias("chosen"))
    runs = own.select(group, F.col(unit).alias("_out")).distinct().join(total, group).join(own.withColumnRenamed(unit, "_out"), [group, candidate, "_out"], "left")
    runs = runs.withColumn("_left", F.col("_all_n") - F.coalesce("_n", F.lit(0))).where("_left > 0")
    again = runs.groupBy(group, "_out").agg(pick((F.col("_all_s") - F.coalesce("_s", F.lit(0.0))) / F.col("_left")).alias("_pick"))
    return again.join(full, group).groupBy(group).agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("reruns"), F.avg(F.when(F.col("_pick") == F.col("chosen"), 100.0).otherwise(0.0)).alias("stability_pct"))


def selection_bootstrap(rows: DataFrame, candidate: str, unit: str, value: str, seed: int, replicates: int = 32) -> DataFrame:
    """Per replicate: the candidate that has the greatest mean on the units drawn (ties: the smallest), that mean, and its
    mean on the units that were not drawn, with their number. Rows are candidates x units x replicates; a unit's own rows
    are added up first."""
    own = rows.where(F.col(value).isNotNull()).groupBy(candidate, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.orderBy(unit)
    # A row per unit, such as a trading day.
    units = own.select(unit).distinct().withColumns({"_i": F.row_number().over(w) - 1, "_k": F.count(F.lit(1)).over(Window.partitionBy())})
    reps = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = reps.select("rep", hash_index(F.lit(seed), F.col("rep"), F.col("_i"), F.col("_k")).alias("_i")).groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("_t"))
    drawn = draws.join(units.select(unit, "_i"), "_i").select("rep", unit, "_t")
    inside = drawn.join(own, unit).groupBy("rep", candidate).agg((F.sum(F.col("_t") * F.col("_s")) / F.sum(F.col("_t") * F.col("_n"))).alias("_m"))
    pick = inside.groupBy("rep").agg(F.max_by(F.struct(candidate, "_m"), F.struct(F.round("_m", 9), -F.col(candidate))).alias("x")).select("rep", f"x.{candidate}", F.col("x._m").alias("mean_drawn"))
    left = pick.join(own, candidate).join(drawn, ["rep", unit], "left_anti").groupBy("rep").agg((F.sum("_s") / F.sum("_n")).alias("mean_left_out"), F.count(F.lit(1)).alias("units_left_out"))
    return pick.join(left, "rep", "left").select("rep", F.col(candidate).alias("chosen"), "mean_drawn", "mean_left_out", F.coalesce("units_left_out", F.lit(0)).alias("units_left_out"))


def walk_forward_selection(rows: DataFrame, candidate: str, unit: str, value: str, train: int, validate: int) -> DataFrame:
    """Per expanding fold: the candidate chosen on all units before it, its mean there and its mean on the fold's units. Folds
    of ``validate`` units follow the first ``train``; a last, shorter one is left out."""
    own = rows.where(F.col(value).isNotNull()).groupBy(candidate, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    units = own.select(unit).distinct().withColumn("_i", F.row_number().over(Window.orderBy(unit)) - 1)
    own = own.join(units, unit)
    folds = units.agg(F.count(F.lit(1)).alias("_k")).select("_k", F.explode(F.when(F.col("_k") >= train + validate, F.sequence(F.lit(0), F.floor((F.col("_k") - train - validate) / validate)))).alias("fold"))
    folds = folds.select("fold", (F.col("fold") * validate + train).alias("_a"))
    j = own.join(F.broadcast(folds)).where(f"_i < _a + {validate}")  # a row per fold
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("_s"))), F.sum(F.when(c, F.col("_n"))))
    m = j.groupBy("fold", candidate).agg(mean(F.col("_i") < F.col("_a")).alias("_t"), mean(F.col("_i") >= F.col("_a")).alias("_v")).where("_t is not null")
    best = m.groupBy("fold").agg(F.max_by(F.struct(candidate, "_t", "_v"), F.struct(F.round("_t", 9), -F.col(candidate))).alias("x"))
    return best.select(F.col("fold").cast("int").alias("fold"), F.col(f"x.{candidate}").alias("chosen"), F.col("x._t").alias("train"), F.col("x._v").alias("validate"))


def changes_of_known(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per group how often the value changes from one known value to the next; unknown (null) ones in between count as nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(w))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("known"))
    return n.join(d.groupBy(*keys).agg(F.count_if(F.col("_p") != F.col(value)).alias("changes")), keys, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))


def until_next(starts: DataFrame, stops: DataFrame, keys: list[str], reach_us: int) -> DataFrame:
    """Adds until: the earlier of t + reach_us and the first stop of the same keys after t. One window over the union; a
    start looks forward through a running minimum in descending time."""
    cols = starts.columns
    u = starts.select(*keys, "t", F.struct(*cols).alias("_x")).unionByName(stops.select(*keys, "t"), allowMissingColumns=True)
    after = Window.partitionBy(*keys).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_stop", F.min(F.when(F.col("_x").isNull(), F.col("t"))).over(after)).where("_x is not null")
    return u.select("_x.*", F.least(F.col("t") + reach_us, "_stop").alias("until"))
