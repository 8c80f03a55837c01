"""Dates, retries, pacing and limits as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def unix_nanos(c) -> Column:
    """RFC 3339 to decimal nanoseconds (microseconds at best), '' where it can't be read."""
    return F.coalesce((F.unix_micros(F.try_to_timestamp(col(c))) * 1000).cast("string"), F.lit(""))


def rfc3339(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def backoff(attempt, base_s: float = 0.5, cap_s: float = 30.0, retry_after=None) -> Column:
    """Delay before a retry without its jitter: doubled each time, at least what the server asks, never over the cap."""
    wait = F.lit(base_s) * F.pow(F.lit(2.0), col(attempt) - 1)
    wait = wait if retry_after is None else F.greatest(wait, F.coalesce(col(retry_after).cast("double"), F.lit(0.0)))
    return F.least(wait, F.lit(cap_s))


def jittered(wait, key) -> Column:
    """Full jitter: a share of the wait by a hash of the key, so that a rerun waits as long."""
    return col(wait) * hash_share(key)


def hash_share(key) -> Column:
    """0 up to 1 by 32 bits of a digest of the key, the same on every engine."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def transient(status) -> Column:
    return col(status).isin(408, 429, 500, 502, 503, 504)


def ramp(load, low: float = 60.0, high: float = 85.0) -> Column:
    """0 up to low, 1 from high on, straight between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(load) - low) / (high - low)))


def pacing_interval(load, longest_s: float = 2.0) -> Column:
    return ramp(load) * longest_s


def threads(load, least: int = 1, most: int = 10) -> Column:
    """Threads fall from most to least as the load rises; halves go to the even number."""
    return F.bround(F.lit(float(most)) - ramp(load) * (most - least)).cast("int")


def severity_of(elapsed_s, window_s: float) -> Column:
    e = col(elapsed_s)
    return F.when(e >= 4 * window_s, "critical").when(e >= 2 * window_s, "error").when(e >= window_s, "warn")


def memory_limits(cost_mb, margin_mb, budget_mb, reserve_mb) -> Column:
    ceiling = col(cost_mb) + col(margin_mb)
    hard = col(budget_mb) - col(reserve_mb)
    return F.struct(ceiling.alias("ceiling_mb"), F.when(hard > ceiling, hard).otherwise(ceiling + col(margin_mb)).alias("hard_mb"))


def first_offset(text, surface) -> Column:
    """Code-point offset of the first occurrence, -1 if there is none."""
    return F.when(F.coalesce(col(surface), F.lit("")) == "", -1).otherwise(F.instr(col(text), col(surface)) - 1)


def relative_drop(base, now) -> Column:
    return F.when(col(base) > 0, (col(base) - col(now)) / col(base)).otherwise(0.0)


def overlay(remote, local) -> Column:
    """A setting set remotely wins, an explicit zero included."""
    return F.coalesce(col(remote), col(local))
