"""Times and durations as the interface shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cat(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def duration(seconds: Column, hours: bool = True) -> Column:
    """Seconds; minutes and seconds; hours and minutes (files have no hours). Zero parts are left out, null stays null."""
    s = seconds.cast("bigint")
    minutes, rest = F.floor(s / 60), s % 60
    short = F.when(rest > 0, _cat(minutes, " мин. ", rest, " сек.")).otherwise(_cat(minutes, " мин."))
    out = F.when(s.isNull(), None).when(s < 60, _cat(s, " сек."))
    if not hours:
        return out.otherwise(short)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return out.when(s < 3600, short).otherwise(F.when(m > 0, _cat(h, " ч. ", m, " мин.")).otherwise(_cat(h, " ч.")))


def moscow(utc: Column) -> Column:
    """A zone-less UTC time as Moscow's."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), utc)


def shown(time: Column, pattern: str = "dd.MM.yyyy HH:mm", zone: str | None = None) -> Column:
    """Formatted; empty for null."""
    text = F.date_format(time, pattern)
    return F.coalesce(text if zone is None else F.concat(text, F.lit(f" {zone}")), F.lit(""))


def time_ago(utc: Column, now: Column) -> Column:
    """How long before `now`; from 30 days on, the Moscow date. A future time is just now, null is empty."""
    s = F.timestamp_diff("SECOND", utc, now)
    n = lambda unit: F.floor(s / unit)
    days = n(86400)
    out = F.when(utc.isNull(), "").when(s < 60, "только что").when(s < 3600, _cat(n(60), " мин. назад")).when(s < 86400, _cat(n(3600), " ч. назад")).when(s < 172800, "вчера")
    return out.when(days < 7, _cat(days, " дн. назад")).when(days < 30, _cat(F.floor(days / 7), " нед. назад")).otherwise(F.date_format(moscow(utc), "dd.MM.yyyy"))
