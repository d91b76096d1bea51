"""Implausible readings per source: spikes, stuck values and impossible numbers.

A reading's residual is its log distance from the reference (the mark), less the source's seasonal median for
that time slice; in a slice without any mark it is the distance from the source's own median price in that slice, and
such slices are fitted apart from the others. Per source, field and side a generalised Pareto tail is fitted to the residuals over a high
quantile (peaks over threshold), together with a few exceedances of all sources' mean, so that short sources have
a tail too; the cutoff is the level passed with a fixed small risk. A reading keeps the residual it had when it
first appeared, so a value that is merely old is no spike. Stuck stretches are runs too long for the source's own
repeat rate; impossible numbers fall to plain rules.

Three passes, all in the JVM: quantiles per (session, slice), exceedance moments per session, and one window
pass per (session, slice). Slices split a hot session over many tasks; runs are carried across slice borders
by a scan over one summary row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize, small

FIELDS = ("bid", "ask", "last")
#: Seconds of a time slice: the season's bin and the unit of work.
SLICE_S = 900
#: Probability that a sound reading passes its cutoff.
RISK = 1e-6
#: Share of a slice's readings beyond the quantile that sets a side's threshold.
TAIL = 0.1
#: Exceedances of all sessions' mean that count beside a session's own.
POOL = 20
#: Exceedances beyond so many reaches of a side stay out of the fit.
TRIM = 8
#: Largest shape of a fitted tail: sound residuals are not heavier.
SHAPE_MAX = 0.1
#: Probability that a sound run of repeats is as long as the shortest stuck one; never fewer readings than STUCK_MIN.
STUCK_RISK = 1e-7
STUCK_MIN = 16
#: Largest number that can be a price; beyond lie the sentinels of feeds.
LIMIT = 1e8


def impossible(v: Column) -> Column:
    """Not a number, infinite, not above zero, or a sentinel."""
    return v.isNotNull() & (F.isnan(v) | (v <= 0) | (v >= LIMIT))


def _base(ticks: DataFrame) -> DataFrame:
    d = ticks.where("tick_id is not null").select(
        "session_id", F.unix_micros("captured_at_utc").alias("us"), "tick_id", *[F.col(f).cast("double").alias(f) for f in FIELDS], F.col("mark_price").cast("double").alias("mark"),
        F.coalesce(F.nullif(F.regexp_replace("changed_fields", " ", ""), F.lit("")), F.lit(",".join(FIELDS))).alias("changed"),
    )
    good = F.when((F.col("mark") > 0) & (F.col("mark") < LIMIT), F.col("mark"))
    r = [F.when(~impossible(F.col(f)), F.ln(F.col(f) / good)).alias(f"r_{f}") for f in FIELDS]
    r += [F.when(~impossible(F.col(f)) & good.isNull(), F.ln(F.col(f))).alias(f"l_{f}") for f in FIELDS]
    slice_ = F.coalesce(F.floor(F.col("us") / (SLICE_S * 1_000_000)), F.lit(-1)).alias("slice")
    return d.select("session_id", slice_, "us", "tick_id", *FIELDS, *r, good.alias("good"), (0.01 / good).alias("unit"), "changed")


def _seasons(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per slice: seasonal medians; per session and kind of reference: centre, quartile distance and reach of each field's sides)."""
    five = F.array(*map(F.lit, (TAIL, 0.25, 0.5, 0.75, 1 - TAIL)))
    q = [F.percentile_approx(f"{x}_{f}", five, 1000).alias(f"{y}_{f}") for f in FIELDS for x, y in (("r", "q"), ("l", "o"))]
    n = [F.count(f"{x}_{f}").alias(f"{y}_{f}") for f in FIELDS for x, y in (("r", "n"), ("l", "m"))]
    s = base.groupBy("session_id", "slice").agg(*q, *n, F.max("unit").alias("unit"), F.min_by("good", F.when(F.col("good").isNotNull(), F.struct("us", "tick_id"))).alias("good0"))
    own = F.col("good0").isNull()  # no mark in the whole slice: its own median is the reference
    unit = F.when(own, 0.01 / F.exp(F.greatest(*[F.col(f"o_{f}")[2] for f in FIELDS]))).otherwise(F.col("unit")).alias("unit")
    pick = [F.when(own, F.col(f"{o}_{f}")).otherwise(F.col(f"{x}_{f}")).alias(f"{x}_{f}") for f in FIELDS for x, o in (("q", "o"), ("n", "m"))]
    s = materialize(s.select("session_id", "slice", own.alias("own"), "good0", unit, *pick))
    at = lambda f, i: F.col(f"q_{f}")[i]
    agg: list[Column] = [F.max("unit").alias("unit")]
    for f in FIELDS:
        # Medians over the slices weighted by their readings: a slice full of excursions moves them little.
        mid = lambda c, f=f: F.percentile(c, 0.5, F.col(f"n_{f}"))
        agg += [mid(at(f, 2)).alias(f"c_{f}"), (2 * F.least(mid(at(f, 3) - at(f, 2)), mid(at(f, 2) - at(f, 1)))).alias(f"b_{f}")]
        agg += [mid(at(f, 4) - at(f, 2)).alias(f"a_hi_{f}"), mid(at(f, 2) - at(f, 0)).alias(f"a_lo_{f}")]
    return s, s.groupBy("session_id", "own").agg(*agg)


def _offset(f: str) -> Column:
    """Seasonal median of a slice with enough readings, held near the session's centre; a slice without marks keeps its own."""
    band = 0.5 * F.greatest(f"b_{f}", "unit")
    near = F.greatest(F.col(f"c_{f}") - band, F.least(F.col(f"c_{f}") + band, F.col(f"q_{f}")[2]))
    return F.when(F.col("own"), F.col(f"q_{f}")[2]).when(F.col(f"n_{f}") >= 20, near).otherwise(F.col(f"c_{f}"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Same session and kind of reference; of ``b`` the columns _m and _own."""
    return a["session_id"].eqNullSafe(b["_m"]) & (a["own"] == b["_own"])


def _reach(f: str, side: str, other: str) -> Column:
    """The distance of the TAIL quantile of a side: prices are quantised, so one price unit at least. A stuck stretch
    drifts to one side and widens it; neither side may exceed twice the other."""
    # Around its own median a price wanders in one slice more than in others: a slice without marks has its own width.
    q = F.col(f"q_{f}")
    width = {"hi": q[4] - q[2], "lo": q[2] - q[0]}
    a, b = (F.greatest(F.col(f"a_{d}_{f}"), F.col("unit"), F.when(F.col("own"), width[d])) for d in (side, other))
    return F.least(a, 2 * b)


def _fit(f: str, side: str) -> Column:
    """The level passed with probability RISK: GPD by moments over the exceedances of the threshold. POOL exceedances of
    all sessions' mean are added to the session's own, so that a short session leans on the others by degrees."""
    c = lambda x: F.col(f"{x}_{side}_{f}")
    everywhere = F.greatest(c("all_k"), F.lit(1))
    k = c("k") + POOL
    mean = (c("s") + POOL * F.coalesce(c("all_s"), F.lit(0.0)) / everywhere) / k
    var = (c("t") + POOL * F.coalesce(c("all_t"), F.lit(0.0)) / everywhere) / k - mean * mean
    shape = F.greatest(F.lit(-0.2), F.least(F.lit(SHAPE_MAX), 0.5 * (1 - mean * mean / F.greatest(var, 1e-18 + 0.01 * mean * mean))))
    scale = mean * (1 - shape)
    ratio = F.greatest(F.lit(1.0), k / F.greatest(F.col(f"n_{f}") + POOL * F.col(f"all_n_{f}") / everywhere, F.lit(1.0)) / RISK)
    level = F.when(F.abs(shape) < 0.01, scale * F.ln(ratio)).otherwise(scale / shape * (F.pow(ratio, shape) - 1))
    return c("a") - 0.5 * F.col("unit") + level * c("a")


def fits(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per slice: off_f of each field; per session: the exceedances of each field's sides, and those of all sessions)."""
    s, per = _seasons(base)
    per = per.withColumnsRenamed({"unit": "_unit", "session_id": "_m", "own": "_own"})
    s = materialize(s.join(per, _same(s, per)).drop("unit").withColumnRenamed("_unit", "unit")
        .select("session_id", "slice", "own", "good0", "unit", *[c for f in FIELDS for c in (_offset(f).alias(f"off_{f}"), _reach(f, "hi", "lo").alias(f"a_hi_{f}"), _reach(f, "lo", "hi").alias(f"a_lo_{f}"))]))
    p = small(s.drop("good0").withColumnsRenamed({"session_id": "_sid", "slice": "_slice", "unit": "_unit"}))
    j = base.join(p, base["session_id"].eqNullSafe(p["_sid"]) & (base["slice"] == p["_slice"]))
    agg = [F.max("_unit").alias("unit")]
    for f in FIELDS:
        # Only readings that changed: a value that is merely carried on says nothing of the market's noise.
        e = F.when(F.concat(F.lit(","), "changed", F.lit(",")).contains(f",{f},"), F.when(F.col("own"), F.col(f"l_{f}")).otherwise(F.col(f"r_{f}")) - F.col(f"off_{f}"))
        agg.append(F.count(e).alias(f"n_{f}"))
        for side, x in (("hi", e), ("lo", -e)):
            # A rounded reading stands for half a unit to either side: the threshold lies so far below the quantile,
            # which leaves about the share TAIL above it. Excesses count in reaches, alike in all sessions.
            a = F.col(f"a_{side}_{f}")
            y = (x - a + 0.5 * F.col("_unit")) / a
            over = F.when((y > 0) & (x <= TRIM * a), y)  # beyond lie the excursions themselves: they must not widen the tail
            agg += [F.count(over).alias(f"k_{side}_{f}"), F.coalesce(F.sum(over), F.lit(0.0)).alias(f"s_{side}_{f}"), F.coalesce(F.sum(over * over), F.lit(0.0)).alias(f"t_{side}_{f}"), F.max(a).alias(f"a_{side}_{f}")]
    m = materialize(j.groupBy("session_id", "own").agg(*agg))
    pool = m.groupBy("own").agg(*[F.sum(f"n_{f}").alias(f"all_n_{f}") for f in FIELDS], *[F.sum(f"{c}_{d}_{f}").alias(f"all_{c}_{d}_{f}") for c in "kst" for d in ("hi", "lo") for f in FIELDS])
    return s, m.join(F.broadcast(pool), "own")  # two rows at most


def thresholds(base: DataFrame) -> DataFrame:
    """Per (session, slice): off_f, hi_f, lo_f of each field, and the repeat-free parameters for the spike rule."""
    s, m = fits(base)
    cut = [_fit(f, d).alias(f"{d}_{f}") for f in FIELDS for d in ("hi", "lo")]
    m = m.select(F.col("session_id").alias("_m"), F.col("own").alias("_own"), *cut)
    return materialize(s.join(m, _same(s, m)).select("session_id", "slice", "own", "good0", *[c for f in FIELDS for c in (f"off_{f}", f"hi_{f}", f"lo_{f}")]))


def _runs(base: DataFrame, th: DataFrame) -> DataFrame:
    """Per tick (deduplicated, in order within its slice) and field: the run's number, the place in it, and how far
    the run's first residual lies beyond its cutoff (above 1 is a spike). One shuffle and one sort."""
    key = ["session_id", "slice"]
    w = Window.partitionBy(*key).orderBy("us", "tick_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = base.join(th, base["session_id"].eqNullSafe(th["_sid"]) & (base["slice"] == th["_slice"]))
    # A reading without a mark in a slice with marks is measured against the mark before it, at the start the first, and
    # the next reading's: what lies between both counts as no distance.
    mark = F.coalesce("good", F.last("good", True).over(past), "good0")
    d = d.withColumns({"_mark": mark, "_soon": F.lead("good").over(w), "_good": F.lag("good").over(w), "_dup": F.lag("tick_id").over(w)} | {f"q_{f}": F.lag(f).over(w) for f in FIELDS} | {f"p_{f}": F.last(f, True).over(past) for f in FIELDS})
    d = d.withColumns({f"r_{f}": F.coalesce(f"r_{f}", F.when(F.col("own"), F.col(f"l_{f}")).otherwise(F.ln(F.when(~impossible(F.col(f)), F.col(f)) / F.col("_mark")))) for f in FIELDS})
    for f in FIELDS:
        r, soon = F.col(f"r_{f}"), F.ln(F.when(~impossible(F.col(f)), F.col(f)) / F.col("_soon"))
        between = F.least(F.greatest(F.col(f"off_{f}"), F.least(r, soon)), F.greatest(r, soon))
        d = d.withColumn(f"r_{f}", F.when(F.col("good").isNull() & ~F.col("own"), between).otherwise(r))
    beyond = lambda r, f: F.greatest((r - F.col(f"off_{f}")) / F.col(f"hi_{f}"), (F.col(f"off_{f}") - r) / F.col(f"lo_{f}"))
    # After a null reading a value may be older than it looks: the nearer of both instants' references counts.
    x = [F.when(F.col(f"q_{f}").isNull(), F.least(beyond(F.col(f"r_{f}"), f), beyond(F.ln(F.when(~impossible(F.col(f)), F.col(f)) / F.col("_good")), f))).otherwise(beyond(F.col(f"r_{f}"), f)).cast("float").alias(f"x_{f}") for f in FIELDS]
    d = d.select(*key, "us", "tick_id", "_dup", *FIELDS, *[f"p_{f}" for f in FIELDS], *x)
    # A second delivery repeats its reading, so it opens no run; it is dropped before readings are counted.
    d = d.where("_dup is null or _dup <> tick_id").drop("_dup")
    d = d.withColumns({f"new_{f}": F.when(F.col(f).isNotNull() & ~F.col(f"p_{f}").eqNullSafe(F.col(f)), 1) for f in FIELDS})
    d = d.withColumns({f"i_{f}": F.count(f).over(w) for f in FIELDS} | {f"run_{f}": F.count(f"new_{f}").over(w).cast("int") for f in FIELDS})
    first = {f"at_{f}": F.last(F.when(F.col(f"new_{f}") == 1, F.struct(F.col(f"i_{f}").alias("i"), F.col(f"x_{f}").alias("x"))), True).over(w) for f in FIELDS}
    d = d.withColumns(first)
    cols = [c for f in FIELDS for c in (F.col(f), F.col(f"run_{f}"), F.col(f"i_{f}").cast("int").alias(f"i_{f}"), (F.col(f"i_{f}") - F.col(f"at_{f}.i") + 1).cast("int").alias(f"n_{f}"), F.col(f"at_{f}.x").alias(f"x_{f}"))]
    return d.select(*key, "tick_id", *cols)


def _borders(wide: DataFrame) -> DataFrame:
    """(session_id, field, slice, ord, run, v, n, x): the first and the last run of every slice, once where they are one."""
    agg = [F.count(F.lit(1)).alias("rows")]
    for f in FIELDS:
        here = F.col(f).isNotNull()
        first, last = F.struct(f, f"x_{f}"), F.struct(f, f"x_{f}", f"n_{f}")
        agg += [
            F.min_by(first, F.when(here, F.col(f"i_{f}"))).alias(f"a_{f}"), F.max(F.when(here & (F.col(f"run_{f}") == 1), F.col(f"n_{f}"))).alias(f"an_{f}"),
            F.max_by(last, F.when(here, F.col(f"i_{f}"))).alias(f"z_{f}"), F.max(f"run_{f}").alias(f"r_{f}"),
        ]
    s = wide.groupBy("session_id", "slice").agg(*agg)
    rows = []
    for f in FIELDS:
        one = lambda o, run, v, n, x, f=f: F.struct(F.lit(f).alias("field"), F.lit(o).alias("ord"), run.alias("run"), v.alias("v"), n.alias("n"), x.alias("x"))
        a, z, r = F.col(f"a_{f}"), F.col(f"z_{f}"), F.col(f"r_{f}")
        rows.append(F.when(r >= 1, one(0, F.lit(1), a[f], F.col(f"an_{f}"), a[f"x_{f}"])))
        rows.append(F.when(r >= 2, one(1, r, z[f], z[f"n_{f}"], z[f"x_{f}"])))
    return s.select("session_id", "slice", F.explode(F.array_compact(F.array(*rows))).alias("_")).select("session_id", "slice", "_.*")


def _corrections(wide: DataFrame) -> DataFrame:
    """(session_id, slice, field, run, stuck, skip, x): for long runs and for runs that cross slice borders, whether the
    run is stuck, how many of its readings lie in earlier slices, and the residual with which it began."""
    o = Window.partitionBy("session_id", "field").orderBy("slice", "ord")
    b = _borders(wide)
    # Only runs of different slices join; the first and the last run of one slice never do.
    goes_on = (F.lag("v").over(o) == F.col("v")) & (F.lag("slice").over(o) != F.col("slice"))
    b = b.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("_new").over(o))
    c = Window.partitionBy("session_id", "field", "chain").orderBy("slice", "ord")
    every = c.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumns({"total": F.sum("n").over(every), "links": F.count(F.lit(1)).over(every), "skip": F.coalesce(F.sum("n").over(c.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "x0": F.first("x").over(c)})
    border = b.where(f"links > 1 or total >= {STUCK_MIN}").select("session_id", "slice", "field", "run", "total", "skip", "x0")
    row = [F.struct(F.lit(f).alias("field"), F.col(f"run_{f}").alias("run"), F.col(f"n_{f}").alias("n"), F.col(f"x_{f}").alias("x")) for f in FIELDS]
    long = wide.where(" or ".join(f"n_{f} >= {STUCK_MIN}" for f in FIELDS)).select("session_id", "slice", F.explode(F.array(*row)).alias("_")).select("session_id", "slice", "_.*")
    inner = long.where(f"n >= {STUCK_MIN}").groupBy("session_id", "slice", "field", "run").agg(F.max("n").cast("long").alias("total"), F.lit(0).cast("long").alias("skip"), F.max("x").alias("x0"))
    runs = border.unionByName(inner).groupBy("session_id", "slice", "field", "run").agg(F.max("total").alias("total"), F.max("skip").alias("skip"), F.max_by("x0", "total").alias("x0"))
    # The source's own repeat rate, long runs aside, says how long a sound run can be.
    n = wide.groupBy("session_id", "slice").agg(*[F.count(f).alias(f"n_{f}") for f in FIELDS], *[F.max(f"run_{f}").alias(f"r_{f}") for f in FIELDS]).groupBy("session_id").agg(*[F.sum(f"{k}_{f}").alias(f"{k}_{f}") for f in FIELDS for k in "nr"])
    n = n.select("session_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"r_{f}").alias("r")) for f in FIELDS])).alias("_")).select("session_id", "_.*")
    out = runs.where(f"total >= {STUCK_MIN}").groupBy("session_id", "field").agg(F.sum(F.when(F.col("skip") == 0, F.col("total"))).alias("gone"), F.count(F.when(F.col("skip") == 0, 1)).alias("gone_runs"))
    out = out.withColumnsRenamed({"session_id": "_s", "field": "_f"})
    rate = n.join(out, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")))
    rate = rate.select("_s", "_f", ((F.col("n") - F.col("r") - F.col("gone") + F.col("gone_runs")) / F.greatest(F.col("n") - F.col("gone"), F.lit(1))).alias("p"))
    long_enough = F.greatest(F.lit(float(STUCK_MIN)), 1 + F.log(F.lit(STUCK_RISK)) / F.log(F.least(F.lit(0.9), F.greatest(F.lit(0.01), F.coalesce("p", F.lit(0.01))))))
    runs = runs.join(rate, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")), "left")
    return runs.select("session_id", "slice", "field", "run", (F.col("total") >= long_enough).alias("stuck"), "skip", "x0")


def flag_readings(ticks: DataFrame) -> DataFrame:
    """Rows (tick_id, field, rule): one per flagged reading; rule is impossible, spike or stuck, the first that holds.

    Readings are ordered by (captured_at_utc, tick_id); repeated deliveries of a tick count once; null readings
    are neither flagged nor break a run. A spike's flag holds for the repeats of its value; a stuck run is
    flagged from its second row on. A reading without a usable mark (null or not above zero) is measured
    against the latest one of its slice, and in a slice without any against the slice's own median price. Null session ids form one source, null instants one slice; rows with a null tick_id
    are left out. Extra columns and an empty table are harmless.
    """
    base = _base(ticks)
    th = small(thresholds(base).withColumnsRenamed({"session_id": "_sid", "slice": "_slice"}))
    wide = materialize(_runs(base, th))
    fix = small(materialize(_corrections(wide)).withColumnsRenamed({"session_id": "_sid", "slice": "_slice", "field": "_field", "run": "_run"}))
    row = [F.struct(F.lit(f).alias("field"), F.col(f).alias("v"), F.col(f"run_{f}").alias("run"), F.col(f"n_{f}").alias("n"), F.col(f"x_{f}").alias("x")) for f in FIELDS]
    long = wide.select("session_id", "slice", "tick_id", F.explode(F.array(*row)).alias("_")).select("session_id", "slice", "tick_id", "_.*").where("v is not null")
    j = long.join(fix, long["session_id"].eqNullSafe(fix["_sid"]) & (long["slice"] == fix["_slice"]) & (long["field"] == fix["_field"]) & (long["run"] == fix["_run"]), "left")
    rule = (
        F.when(impossible(F.col("v")), "impossible")
        .when(F.when(F.col("_run").isNotNull(), F.col("x0")).otherwise(F.col("x")) > 1, "spike")
        .when(F.col("stuck") & (F.col("skip") + F.col("n") > 1), "stuck")
    )
    return j.select("tick_id", "field", rule.alias("rule")).where("rule is not null")
