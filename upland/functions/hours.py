"""Opening hours and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upland.functions.geo import col

CITY_ZONE = "Asia/Manila"
HHMM = r"^\d\d:\d\d$"


def to_minutes(hhmm) -> Column:
    parts = F.split(col(hhmm), ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def local_minutes(ts, zone: str = CITY_ZONE) -> Column:
    """Minutes after local midnight of a UTC instant."""
    local = F.from_utc_timestamp(col(ts), zone)
    return F.hour(local) * 60 + F.minute(local)


def open_at(hours, minutes) -> Column:
    """No hours: always open. Same open and close: all day. Close before open: past midnight. [open, close)."""
    h, m = col(hours), col(minutes)
    opens, closes = to_minutes(h["open"]), to_minutes(h["close"])
    return (
        F.when(h.isNull(), F.lit(True))
        .when(opens == closes, F.lit(True))
        .when(closes > opens, (m >= opens) & (m < closes))
        .otherwise((m >= opens) | (m < closes))
    )


def valid_hours(open_, close) -> Column:
    return F.coalesce(col(open_).rlike(HHMM) & col(close).rlike(HHMM), F.lit(False))


def valid_price(value) -> Column:
    return F.coalesce(col(value).between(1, 4), F.lit(False))
