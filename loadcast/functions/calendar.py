"""Calendar arithmetic on TIMESTAMP_NTZ wall clocks.

Nothing here depends on the session time zone, and nothing uses higher-order
functions, so the expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadcast.params import DRY_MONTHS, RESET_HOUR, ZONE


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def add_hours(t: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), t)


def add_days(t: Column, days: int) -> Column:
    return t + F.make_dt_interval(F.lit(days))


def truncate_hour(t: Column) -> Column:
    return F.timestamp_add("HOUR", F.hour(t), t.cast("date").cast("timestamp_ntz"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b (an interval, so no session zone comes in)."""
    return (b - a).cast("interval second").cast("long")


def wall_clock(utc_seconds: Column, zone: str = ZONE) -> Column:
    """Seconds since 1970 (UTC) to the wall clock of ``zone``."""
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_seconds), zone))
    return F.timestamp_add("SECOND", local, _epoch())


def parse_time(text: Column) -> Column:
    """Date-time text, with or without the clock part."""
    # Both forms are what the NTZ cast accepts; anything else becomes NULL.
    return F.trim(text).try_cast("timestamp_ntz")


def decode_hours(units: Column, hours: Column, zone: str = ZONE) -> Column:
    """Axis values under a unit text such as 'hours since 1900-01-01 00:00:00.0'.

    Fractional noise in the stored hours is rounded to the second; the clock of
    the origin counts.  Another unit stops the query; what is no unit text at all
    gives NULL.
    """
    unknown = F.raise_error(F.concat(F.lit("not hours since a time: "), units)).cast("string")
    text = F.when(units.rlike("^[a-z]+ since "), F.when(units.startswith("hours "), F.substring(units, 13, 64)).otherwise(unknown))
    origin = F.trim(text).try_cast("timestamp_ntz")
    whole_days = F.unix_date(origin.cast("date")).cast("long") * 86400
    clock = F.hour(origin) * 3600 + F.minute(origin) * 60 + F.floor(F.second(origin))
    seconds = whole_days + clock + F.round(hours * 3600).cast("long")
    return wall_clock(seconds, zone)


def representative_time(year: Column, month: Column, hour: Column) -> Column:
    """Stamp of a month's representative day: 08..23 on day 1, 00..07 on day 2."""
    day = F.when(hour >= RESET_HOUR, 1).otherwise(2)
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))


def month_number(text: Column) -> Column:
    """Month as a number, from a number or an English name or abbreviation."""
    names = F.array(*[F.lit(n) for n in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    place = F.array_position(names, F.lower(F.substring(F.trim(text), 1, 3)))
    return F.coalesce(F.trim(text).try_cast("int"), F.nullif(place, F.lit(0)).cast("int"))


def month_start(t: Column) -> Column:
    return F.trunc(t.cast("date"), "month")


def next_month_start(t: Column) -> Column:
    return F.add_months(month_start(t), 1)


def days_in_month(t: Column) -> Column:
    return F.day(F.last_day(t.cast("date")))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def _weekdays_until(day: Column) -> Column:
    # Days since Monday 1970-01-05: five weekdays per full week, plus the rest.
    d = F.unix_date(day) - 4
    return F.floor(d / 7) * 5 + F.least(F.pmod(d, F.lit(7)) + 1, F.lit(5))


def weekday_count(first: Column, last: Column) -> Column:
    """Number of Mondays to Fridays in the closed range [first, last]."""
    return (_weekdays_until(last) - _weekdays_until(F.date_sub(first, 1))).cast("int")


def dry_season(t: Column) -> Column:
    return F.when(F.month(t).between(*DRY_MONTHS), 1.0).otherwise(0.0)


def hour_angle(t: Column) -> Column:
    return F.hour(t) * (3.141592653589793 * 2) / 24
