"""Parameter grids: neighbourhood, connected near-best regions, exact collapse of equal profiles."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest grid, in points, that is searched for regions on the driver.
GRID_POINTS = 200_000


def product(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """All combinations of the axes, built by explodes."""
    d = spark.range(1).select()
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return d


#: The axes of a profile's multipliers, each with whether it may be zero.
AXES = {"initial_x": False, "buy_x": True, "profit_x": False, "sell_x": True}
#: The steps of the staged search.
POLICIES = {"off": [0.0], "manual": [1.0, 2.0, 3.0, 4.0, 5.0], "atr": [1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5]}
PERIODS = [5, 7, 10, 14, 21, 28]
BARS = [15, 30, 60, 120]
SCREEN = [(1.5, 0.75, 1.0, 1.0), (1.0, 0.5, 0.75, 0.75), (2.0, 1.0, 1.25, 1.25), (2.0, 1.0, 1.0, 1.0), (1.5, 0.75, 0.75, 0.5)]
COARSE = {"initial_x": [0.75, 1.5, 2.25], "buy_x": [0.0, 0.75, 1.25], "profit_x": [0.5, 1.0, 1.5], "sell_x": [0.0, 0.75, 1.25]}
MIN_PCT = [0.01, 0.05, 0.1, 0.2]
FINE = 0.25


def policy_grid(spark: SparkSession) -> DataFrame:
    """(mode, value) of the protective policies."""
    return spark.createDataFrame([(m, v) for m, values in POLICIES.items() for v in values], "mode string, value double")


def window_grid(spark: SparkSession) -> DataFrame:
    """Every window (period, bar_seconds) with every tuple of the screen."""
    return product(spark, {"period": PERIODS, "bar_seconds": BARS}).join(F.broadcast(spark.createDataFrame(SCREEN, ", ".join(f"{a} double" for a in AXES))))


def coarse_grid(spark: SparkSession) -> DataFrame:
    return product(spark, COARSE | {"min_pct": MIN_PCT})


def refined_grid(seeds: DataFrame) -> DataFrame:
    """Every neighbour of the seeds by one fine step in each axis, the seeds among them, once; never below a step, or zero
    where the axis may be zero. Other columns of the seeds stay."""
    d = seeds
    for axis, zero in AXES.items():
        d = d.withColumn(axis, F.explode(F.array(*[F.greatest(F.lit(0.0 if zero else FINE), F.col(axis) + k * FINE) for k in (-1, 0, 1)])))
    return d.distinct()


def boundary_probes(points: DataFrame, best: DataFrame, step: float = FINE) -> DataFrame:
    """Points one step outside the searched range in each axis in which a best point lies at its edge."""
    ends = points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    b = best.join(F.broadcast(ends))  # one row
    out = None
    for axis, zero in AXES.items():
        for at, move in ((f"hi_{axis}", step), (f"lo_{axis}", -step)):
            least = 0.0 if zero else step
            part = b.where((F.col(axis) == F.col(at)) & (F.col(axis) + move >= least)).withColumn(axis, F.col(axis) + move).select(*best.columns)
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def near_best_runs(points: DataFrame, keys: list[str], axis: str, score: str, least: int) -> DataFrame:
    """(keys, first, last, steps, centre, best, worst): runs of at least ``least`` neighbouring whole steps of an axis whose
    score is within max(2, a tenth of the best) of the group's best."""
    w = Window.partitionBy(*keys)
    d = points.withColumn("_top", F.max(score).over(w)).where(F.col(score) >= F.col("_top") - F.greatest(F.lit(2.0), 0.1 * F.abs("_top")))
    d = d.withColumn("_run", F.col(axis) - F.row_number().over(w.orderBy(axis)))
    g = d.groupBy(*keys, "_run").agg(F.min(axis).alias("first"), F.max(axis).alias("last"), F.count(F.lit(1)).alias("steps"), F.max(score).alias("best"), F.min(score).alias("worst"))
    return g.where(F.col("steps") >= least).select(*keys, "first", "last", "steps", F.expr("(first + last) div 2").alias("centre"), "best", "worst")


def collapse(profiles: DataFrame, key: str, behaviour: list[str]) -> DataFrame:
    """(key, leader): profiles that behave alike in every column share the one with the smallest key, which alone is evaluated."""
    lead = profiles.groupBy(*behaviour).agg(F.min(key).alias("leader"))
    on = [profiles[c].eqNullSafe(lead[c]) for c in behaviour]
    return profiles.join(lead, on).select(profiles[key], "leader")


def adjacent(points: DataFrame, axes: list[str], step: float) -> DataFrame:
    """(axis, axes, other): pairs of grid points that differ in exactly one axis, by at most ``step``; other is the
    neighbour's place on it. An equi-join on the other axes per axis, with a range on the one."""
    out = None
    for axis in axes:
        rest = [a for a in axes if a != axis]
        o = points.select(*rest, F.col(axis).alias("other"))
        near = points.join(o, rest).where((F.abs(F.col(axis) - F.col("other")) <= step + 1e-9) & (F.col(axis) != F.col("other")))
        part = near.select(F.lit(axis).alias("axis"), *axes, "other")
        out = part if out is None else out.unionByName(part)
    return out


def near_best_regions(points: DataFrame, axes: list[str], score: str, step: float, share: float = 0.1, least: float = 2.0, members: int = 3) -> DataFrame:
    """(region, axes, score, centre): connected regions, of at least ``members`` grid points, of those within max(least,
    share of the best) of the best score.

    Neighbours differ in one axis by at most ``step``. Region 0 has the best worst score, then the next (ties: the smallest
    point); its centre is the point nearest to the median of each axis (ties: the best score, the smallest point). A grid
    has a documented bound (GRID_POINTS); the union-find over it runs on the driver."""
    spark = points.sparkSession
    rows = points.where(F.col(score).isNotNull()).select(*axes, score).limit(GRID_POINTS + 1).collect()
    if len(rows) > GRID_POINTS:
        raise ValueError(f"a grid of more than {GRID_POINTS} points")
    best = max((r[score] for r in rows), default=0.0)
    near = [r for r in rows if r[score] >= best - max(least, share * abs(best))]
    root = list(range(len(near)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(len(axes)):
        lines: dict[tuple, list[int]] = {}
        for i, r in enumerate(near):
            lines.setdefault(tuple(r[x] for j, x in enumerate(axes) if j != a), []).append(i)
        for line in lines.values():
            line.sort(key=lambda i: near[i][axes[a]])
            for i, j in zip(line, line[1:]):
                if near[j][axes[a]] - near[i][axes[a]] <= step + 1e-9:
                    root[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(near)):
        groups.setdefault(find(i), []).append(i)
    at = lambda i: tuple(float(near[i][x]) for x in axes)
    ranked = sorted((g for g in groups.values() if len(g) >= members), key=lambda g: (-min(near[i][score] for i in g), min(map(at, g))))
    out = []
    for n, g in enumerate(ranked):
        middle = [median(at(i)[a] for i in g) for a in range(len(axes))]
        centre = min(g, key=lambda i: (round(sum(abs(x - m) for x, m in zip(at(i), middle)), 9), -near[i][score], at(i)))
        out += [(n, *at(i), float(near[i][score]), i == centre) for i in g]
    return spark.createDataFrame(out, ", ".join(["region int", *[f"{x} double" for x in axes], f"{score} double", "centre boolean"]))
