"""Scalar functions: times in the session's zone, money, rates, null handling, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = "yyyy-MM-dd HH:mm:ss"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Times


def rowtime_from_millis(c) -> Column:
    """Epoch milliseconds -> timestamp, cut to the second."""
    return F.timestamp_seconds(F.floor(_c(c) / 1000))


def rowtime_from_text(c) -> Column:
    return F.to_timestamp(_c(c), SECOND)


def millis(c) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` -> epoch milliseconds; null where it isn't such a time."""
    return F.unix_millis(F.try_to_timestamp(_c(c), F.lit(SECOND)))


def second_text(c) -> Column:
    return F.date_format(_c(c), SECOND)


def day_key(c) -> Column:
    return F.date_format(_c(c), "yyyyMMdd")


def day_number(c) -> Column:
    return F.date_format(_c(c), "yyyyMMdd").cast("int")


def age(birthday, as_of) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(_c(as_of), _c(birthday)) / 365).cast("int")


def hour_label(c) -> Column:
    return F.lpad(_c(c).cast("string"), 2, "0")


def plus_minutes(c, n: int) -> Column:
    return _c(c) + F.expr(f"INTERVAL {n} MINUTES")


def plus_seconds(c, n: int) -> Column:
    return _c(c) + F.expr(f"INTERVAL {n} SECONDS")


# Nulls and text


def empty(c) -> Column:
    """Null or the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit("")) == ""


def first_non_null(*cs) -> Column:
    return F.coalesce(*map(_c, cs))


def brand(model) -> Column:
    return F.split_part(_c(model), F.lit(" "), F.lit(1))


def query_argument(c) -> Column:
    return F.url_encode(_c(c))


def shard(c, n: int) -> Column:
    """Shard number by hash; results never depend on the value."""
    return F.pmod(F.hash(_c(c)), F.lit(n))


# Money and rates


def money(c) -> Column:
    return _c(c).cast("decimal(16,2)")


def significant(c, digits: int = 2) -> Column:
    """Rounded half up to so many significant digits."""
    x = _c(c).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / unit) * unit)


def _ratio(a: Column, b: Column, scale: int) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(F.round(a.cast("decimal(20,6)") / b.cast("decimal(20,0)"), scale)).cast("double")


def bounce_rate(bounces, sessions) -> Column:
    """Percent of sessions, 2 digits, 0 without sessions."""
    return _ratio(_c(bounces) * 100, _c(sessions), 2)


def dwell_seconds(duration_ms, sessions) -> Column:
    """Milliseconds a session rounded to whole ones, then seconds with 1 digit."""
    whole = F.round(_c(duration_ms).cast("decimal(20,6)") / _c(sessions).cast("decimal(20,0)"), 0)
    return F.when(_c(sessions) == 0, F.lit(0)).otherwise(F.round(whole / 1000, 1)).cast("double")


def pages_per_session(pages, sessions) -> Column:
    return _ratio(_c(pages), _c(sessions), 2)
