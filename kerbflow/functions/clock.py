"""Clock, date and service-day expressions.

Missing is always NULL: nothing here returns a sentinel. ANSI mode is on in Spark 4, so every text to
number step goes through ``try_cast`` or a pattern that can only match digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clock part of a placeholder timestamp, "1900-01-01T05:07:00Z" or
# "1900-01-01 05:07:00.000".
LOOSE_CLOCK = r"^\S*?[T ](\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)Z?\s*$"
STRICT_CLOCK = r"T(\d{2}):(\d{2}):(\d{2})"
GTFS_CLOCK = r"^(\d+):(\d{2}):(\d{2})"
SERVICE_ZONE = "America/New_York"


def _hms(text: Column, pattern: str) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i).try_cast("double")

    return part(1) * 3600 + part(2) * 60 + part(3)


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight from the ``T`` or the space form, fractions kept."""
    return _hms(F.trim(text), LOOSE_CLOCK)


def strict_clock_seconds(text: Column) -> Column:
    """Seconds since midnight from the ``T`` form only, whole seconds."""
    return _hms(text, STRICT_CLOCK)


def strict_minute_hour(text: Column) -> Column:
    """Fractional hour of the ``T`` form, to the minute (seconds ignored)."""
    hour = F.regexp_extract(text, STRICT_CLOCK, 1).try_cast("double")
    minute = F.regexp_extract(text, STRICT_CLOCK, 2).try_cast("double")
    return hour + minute / 60


def gtfs_seconds(text: Column) -> Column:
    """``H:MM:SS`` with hours past 24 to seconds; missing or unreadable parts count as 0."""
    parts = F.split(F.trim(text), ":")

    def part(i: int) -> Column:
        digits = F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^\s*(\d+)", 1)
        return F.coalesce(digits.try_cast("int"), F.lit(0))

    total = part(0) * 3600 + part(1) * 60 + part(2)
    return F.when(F.size(parts) < 2, F.lit(0)).otherwise(total).cast("int")


def fractional_hour(seconds: Column) -> Column:
    return seconds / 3600.0


def hms_text(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS`` (hours may pass 24); NULL stays NULL."""
    whole = F.floor(seconds).cast("bigint")
    return F.when(
        whole.isNotNull(),
        F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60),
                        F.pmod(whole, F.lit(60))),
    )


def window_hour(text: str) -> float:
    """``"07:30"`` → 7.5 for window parameters."""
    hour, minute = (text.split(":") + ["0"])[:2]
    return int(hour) + int(minute) / 60


def service_date(text: Column) -> Column:
    """``YYYYMMDD`` or ISO text to DATE."""
    raw = F.trim(text)
    return F.coalesce(
        F.when(raw.rlike(r"^\d{8}$"), F.try_to_date(raw, "yyyyMMdd")),
        F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"),
    )


def date_label(day: Column) -> Column:
    """Axis label with weekday, ``2024-01-05 (Fri)``."""
    return F.date_format(day, "yyyy-MM-dd (E)")


def local_service_seconds(clock: Column, day: Column, zone: str = SERVICE_ZONE) -> Column:
    """Seconds of the local service day for a UTC clock read on service date ``day``.

    The offset follows the date (daylight saving). A local calendar day before the service date gives a
    negative value, one after it a value past 24 h.
    """
    utc = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + clock)
    local = F.from_utc_timestamp(utc, zone)
    in_day = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return in_day + F.datediff(local.cast("date"), day) * 86400
