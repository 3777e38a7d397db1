"""Numeric, date and scoring column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postrisk.constants import (
    AMP_WEIGHT_LIKES, AMP_WEIGHT_REPLIES, AMP_WEIGHT_REPOSTS, RESPONSE_GREEN, RESPONSE_RED,
    RESPONSE_YELLOW, RISK_WEIGHTS, ZONE_GREEN, ZONE_RED, ZONE_RED_MIN, ZONE_YELLOW,
    ZONE_YELLOW_MIN,
)

# A plain decimal number; Spark's cast also accepts Java suffixes such as "12d",
# which are not numbers in the source data, so the text is checked first.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
OFFSET_PATTERN = r":[0-9.]+\s*(Z|UTC.*|GMT.*|[+-][0-9]{1,2}(:?[0-9]{2})?(:?[0-9]{2})?|[A-Za-z]+/[A-Za-z_/]+)$"
TWITTER_TS_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_count(c) -> Column:
    """Dirty counter -> double >= 0: non-numbers, NaN and null become 0."""
    s = F.regexp_replace(_col(c).cast("string"), r"^[\s\x{0b}]+|[\s\x{0b}]+$", "")
    v = F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    v = F.nanvl(v, F.lit(None).cast("double"))
    return F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))


def parse_ts(c) -> Column:
    """ISO-8601 text (with offset) or the ``Wed Oct 10 20:19:24 +0000 2018`` form -> timestamp."""
    s = F.trim(_col(c).cast("string"))
    tw = F.try_to_timestamp(F.substring(s, 5, 1 << 20), F.lit(TWITTER_TS_FORMAT))
    # a time without an offset is UTC, whatever the session time zone
    as_utc = F.concat(s.try_cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    return F.coalesce(F.when(s.rlike(OFFSET_PATTERN), s.try_cast("timestamp")).otherwise(as_utc), tw)


def hours_between(posted, scraped) -> Column:
    """Hours from post to scrape, floored at 0; null if either side is null."""
    p, s = _col(posted), _col(scraped)
    h = (F.unix_micros(s) - F.unix_micros(p)) / F.lit(3.6e9)
    return F.when(p.isNotNull() & s.isNotNull(), F.greatest(F.lit(0.0), h))


def amplification(likes, reposts, replies) -> Column:
    x = (F.lit(1.0) + F.lit(AMP_WEIGHT_LIKES) * _col(likes) + F.lit(AMP_WEIGHT_REPOSTS) * _col(reposts)
         + F.lit(AMP_WEIGHT_REPLIES) * _col(replies))
    return F.when(x > 0, F.log(x))


def velocity(likes, reposts, replies, hours) -> Column:
    return (_col(likes) + _col(reposts) + _col(replies)) / (_col(hours) + F.lit(1.0))


def _weights(weights):
    w = tuple(float(x) for x in (weights or RISK_WEIGHTS))
    if len(w) != 3 or any(x < 0 for x in w) or abs(sum(w) - 1.0) > 1e-9:
        raise ValueError(f"risk weights must be three non-negative numbers summing to 1, got {w}")
    return w


def risk_score(p, amp, vel, weights=None) -> Column:
    """``round_half_even(100 * (w_h*p + w_a*amp + w_v*vel), 2)``."""
    wh, wa, wv = _weights(weights)
    raw = F.lit(100.0) * (F.lit(wh) * _col(p) + F.lit(wa) * _col(amp) + F.lit(wv) * _col(vel))
    return round2(raw)


def round2(c) -> Column:
    """Two decimals, half to even, of the stored binary value - as Python's ``round`` does.

    2.675 is stored a little below the tie and gives 2.67; rounding its shortest decimal
    form would give 2.68. ``x * 100`` is split into its rounded product and the exact
    rounding error, and the error decides what looks like a tie."""
    x = _col(c).cast("double")
    hi = x * 134217729.0 - (x * 134217729.0 - x)
    p = x * 100.0
    err = (hi * 100.0 - p) + (x - hi) * 100.0
    whole = F.floor(p).cast("double")
    over = (p - whole - 0.5) + err
    up = F.when(over == 0, (whole % 2 != 0)).otherwise(over > 0)
    return F.when(F.abs(x) < 1e13, (whole + F.when(up, 1.0).otherwise(0.0)) / 100.0).otherwise(x)


def _no_nan(c) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def zone(score) -> Column:
    """>= 70 red, >= 40 yellow, else green. NaN and null are green (Python comparison semantics)."""
    s = _no_nan(score)
    return (F.when(s >= ZONE_RED_MIN, F.lit(ZONE_RED))
            .when(s >= ZONE_YELLOW_MIN, F.lit(ZONE_YELLOW))
            .otherwise(F.lit(ZONE_GREEN)))


def response(score) -> Column:
    s = _no_nan(score)
    return (F.when(s >= ZONE_RED_MIN, F.lit(RESPONSE_RED))
            .when(s >= ZONE_YELLOW_MIN, F.lit(RESPONSE_YELLOW))
            .otherwise(F.lit(RESPONSE_GREEN)))


def apply_threshold(p, t) -> Column:
    """1 when ``p >= t`` (inclusive), else 0; NaN/null probabilities predict 0."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(_no_nan(p) >= t, F.lit(1)).otherwise(F.lit(0))


def round6(c) -> Column:
    return F.round(_col(c), 6)
