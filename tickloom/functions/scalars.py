"""Scalar rules as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the fields a level-1 change list may name, in canonical order.
TICK_FIELDS = ["bid", "bid_size", "ask", "ask_size", "last", "last_size", "open", "high", "low", "close", "volume", "mark_price"]


def strict_float(c: Column) -> Column:
    """The number in a text or column, null where it is none, NaN or infinite."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def strict_int(c: Column) -> Column:
    """A whole number written as one, with or without a zero fraction; null for fractions and beyond 2^53."""
    v = strict_float(c)
    return F.when((v == F.floor(v)) & (F.abs(v) <= float(1 << 53)), v.cast("long"))


def truth(c: Column) -> Column:
    """True or false from its usual spellings, null from anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def session_day(c: Column) -> Column:
    """A date from YYYYMMDD or YYYY-MM-DD."""
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd")), F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd")))


def next_weekday(day: Column) -> Column:
    """The following Monday-to-Friday date."""
    n = F.dayofweek(day)
    return F.date_add(day, F.when(n == 6, 3).when(n == 7, 2).otherwise(1))


def to_increment(value: Column, step: Column, up: bool) -> Column:
    """The value on the price grid, rounded up or down, but never below one step; values on the grid within 1e-12 steps
    stay. A step that is null, not finite or not above zero is 0.01. Digits after the point: those of the step, 2 to 8."""
    step = F.when((step > 0) & (step < float("inf")), step).otherwise(0.01)
    units = value / step
    v = F.greatest(step, (F.ceil(units - 1e-12) if up else F.floor(units + 1e-12)) * step)
    out = F.round(v, 8)
    for digits in range(7, 1, -1):
        out = F.when(F.abs(F.round(step, digits) - step) <= 1e-12, F.round(v, digits)).otherwise(out)
    return F.when(value.isNotNull(), out)


def effective_pct(atr_pct: Column, multiplier: Column, low: Column, high: Column, allow_zero: bool = True) -> Column:
    """Struct (pct, state): a multiple of the ATR held between two bounds, then rounded to two digits.

    The unrounded multiple decides; meeting a bound counts as held. A multiplier of zero or below is zero where that is
    allowed; an ATR that is null, not finite or not above zero is unavailable."""
    zero = (multiplier <= 0) & F.lit(allow_zero)
    known = (atr_pct > 0) & (atr_pct < float("inf"))
    raw = atr_pct * multiplier
    state = F.when(zero, "zero").when(~F.coalesce(known, F.lit(False)), "unavailable").when(raw <= low, "min").when(raw >= high, "max").otherwise("raw")
    pct = F.when(state == "zero", 0.0).when(state == "min", low).when(state == "max", high).when(state == "raw", raw)
    return F.struct(F.round(pct, 2).alias("pct"), state.alias("state"))


def multiplier(c: Column) -> Column:
    """A multiplier of the ATR: two digits, 0.01 to 50; zero for zero and below, null for null."""
    return F.when(c <= 0, 0.0).otherwise(F.least(F.lit(50.0), F.greatest(F.lit(0.01), F.when(c.isNotNull(), F.round(c, 2))))) * F.when(c.isNotNull(), 1.0)


def window_part(c: Column, low: int, high: int) -> Column:
    """A length of an ATR window held between its bounds; null for null."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def required_sale(buy: Column, profit_pct: Column, trail_pct: Column) -> Column:
    """The price at which a trailing sale may start: the buy price plus the profit (0.01 % at least), four digits, divided by
    what the trail leaves, four digits. Null without a buy price or with a trail of all."""
    trail = F.greatest(F.lit(0.0), F.coalesce(trail_pct, F.lit(0.0))) / 100
    stop = F.round(buy * (1 + F.greatest(F.lit(0.01), profit_pct) / 100), 4)
    return F.when((buy > 0) & (trail < 1), F.round(stop / (1 - trail), 4))


def improvement_bps(price: Column, base: Column, side: Column) -> Column:
    """How much better than the base a price is, in basis points: lower for a purchase, higher for a sale."""
    return F.when(base > 0, F.when(side == "SLD", price / base - 1).otherwise(1 - price / base) * 10000)


def adverse_residual(bps: Column) -> Column:
    """What is adverse of a residual in basis points, 0 at least; beyond 1000 either way it is no evidence."""
    return F.when(F.abs(bps) <= 1000, F.greatest(F.lit(0.0), bps))


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 10000)


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(F.ltrim(c).rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_name(c: Column) -> Column:
    """A name usable as a folder: letters, digits, dot, dash and underscore, at most 80 characters, never empty. A longer
    name keeps 71 and ends in eight digits of its hash, so different names stay different."""
    t = F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_")
    t = F.regexp_replace(t, "^[._]+|[._]+$", "")
    return F.when(t == "", "unnamed").when(F.length(t) <= 80, t).otherwise(F.concat(F.substring(t, 1, 71), F.lit("_"), F.substring(F.sha2(c, 256), 1, 8)))


def changed_list(c: Column) -> Column:
    """Struct (fields, unknown, repeated): a change list in canonical order, names it should not hold, whether one came twice."""
    raw = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.array(*map(F.lit, TICK_FIELDS))
    return F.struct(
        F.array_intersect(known, raw).alias("fields"),
        F.array_except(raw, known).alias("unknown"),
        (F.size(raw) > F.size(F.array_distinct(raw))).alias("repeated"),
    )


def block_length(n: Column) -> Column:
    """Length of the blocks of a moving-block bootstrap over n units: none below 15, then 2, 3, and the nearest whole number to the cube root, 3 to 5."""
    return F.when(n < 15, None).when(n < 30, 2).when(n < 60, 3).otherwise(F.least(F.lit(5), F.greatest(F.lit(3), F.rint(F.cbrt(n.cast("double"))).cast("int"))))


def hash_index(seed: Column, replicate: Column, draw: Column, size: Column) -> Column:
    """A repeatable index below ``size``: the leading 64 bits of SHA-256 of seed|replicate|draw, modulo size."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), replicate.cast("string"), draw.cast("string")), 256)
    hi = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    # (hi * 2^32 + lo) mod size without leaving 64 bits, for sizes below 2^31.
    return F.pmod(F.pmod(hi, size) * F.pmod(F.lit(1 << 32), size) + lo, size)

#: Connectivity codes of the recorded feed that mean a loss and a restored connection.
LOSS_CODES = [1100, 1300, 2103]
RESTORED_CODES = [1101, 1102, 2104, 2106, 2158]


def connectivity(code: Column, name: Column) -> Column:
    """loss, restored or other, by an event's code, else by its name; a failing recorder is a loss, a new selection of the feed restores."""
    n = F.upper(F.coalesce(name, F.lit("")))
    by_name = F.when(n.rlike("RESTOR|RECONNECT|^(GATEWAY_CONNECTED|MARKET_DATA_RESELECTED)$"), "restored").when(n.rlike("DISCONNECT|CONNECTION_LOST|CONNECTIVITY_LOST|CONNECTION_FAILED|^RECORDING_(CALLBACK_ERROR|FAILED)$"), "loss").otherwise("other")
    return F.when(code.isin(LOSS_CODES), "loss").when(code.isin(RESTORED_CODES), "restored").otherwise(by_name)


def trading_hours(text: Column, zone: Column) -> Column:
    """Array of (open, close) instants from ``YYYYMMDD:HHMM-YYYYMMDD:HHMM;...`` at an exchange; closed days and what does not parse are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), ";")
    good = F.filter(parts, lambda x: F.trim(x).rlike(r"^\d{8}:\d{4}-\d{8}:\d{4}$"))
    at = lambda x, i: F.try_to_timestamp(F.substring(F.trim(x), i, 13), F.lit("yyyyMMdd:HHmm"))
    # The wall clock is read in the session's zone (UTC) and moved to the exchange's.
    spans = F.transform(good, lambda x: F.struct(F.to_utc_timestamp(at(x, 1), zone).alias("open"), F.to_utc_timestamp(at(x, 15), zone).alias("close")))
    return F.filter(spans, lambda s: s["open"].isNotNull() & s["close"].isNotNull() & (s["open"] < s["close"]))


def json_setting(raw: Column) -> Column:
    """A stored setting as text: the value of a JSON scalar, the JSON of anything nested, else the raw text."""
    v = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), raw)
