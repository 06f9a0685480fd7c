"""Time frames and comparison periods, resolved to literals before Spark plans anything.

All ends are inclusive. ``now`` is given, never read from the clock here.
Weeks begin on Monday; months, quarters and years are calendar steps that keep
the day where the month has it; days and weeks are fixed lengths.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

Range = tuple[dt.datetime, dt.datetime]
UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")


class TimeError(ValueError):
    pass


def truncate(t: dt.datetime, unit: str, tz: str = "UTC") -> dt.datetime:
    """The start of the unit in the zone, as naive UTC; an unknown unit is a day."""
    zone = ZoneInfo(tz)
    local = t.replace(tzinfo=dt.UTC).astimezone(zone)
    if unit == "minute":
        return t.replace(second=0, microsecond=0)
    if unit == "hour":
        return t.replace(minute=0, second=0, microsecond=0)
    day = local.date()
    if unit == "week":
        day -= dt.timedelta(days=day.weekday())
    elif unit == "month":
        day = day.replace(day=1)
    elif unit == "quarter":
        day = day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
    elif unit == "year":
        day = day.replace(month=1, day=1)
    return dt.datetime.combine(day, dt.time(), zone).astimezone(dt.UTC).replace(tzinfo=None)


def shift(t: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in ("minute", "hour", "day", "week"):
        return t + n * dt.timedelta(**{unit + "s": 1})
    months = n * {"month": 1, "quarter": 3, "year": 12}[unit]
    at = t.year * 12 + t.month - 1 + months
    year, month = divmod(at, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def from_epoch(x: float) -> dt.datetime:
    """Seconds, or milliseconds where above 1e11."""
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=x / 1000 if abs(x) > 1e11 else x)


@dataclass(frozen=True)
class TimeFrame:
    type: str = "ALL_TIME"
    n: int = 1
    start_ms: int | None = None
    end_ms: int | None = None
    timezone: str = "UTC"

    def resolve(self, now: dt.datetime) -> Range | None:
        """(start, end), or None for no limit."""
        kind, n = self.type.upper(), max(self.n or 1, 1)
        if kind in ("ALL_TIME", "UNSPECIFIED", ""):
            return None
        if kind == "CUSTOM_RANGE":
            if self.start_ms is None or self.end_ms is None:
                raise TimeError("CUSTOM_RANGE needs start and end")
            return tuple(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=x // 1000) for x in (self.start_ms, self.end_ms))
        cut = lambda unit: truncate(now, unit, self.timezone)
        day = dt.timedelta(days=1)
        single = {"TODAY": (0, 1), "YESTERDAY": (-1, 0), "TOMORROW": (1, 2)}
        if kind in single:
            lo, hi = single[kind]
            return cut("day") + lo * day, cut("day") + hi * day
        if kind.endswith("_TO_DATE") and (unit := kind[:-8].lower()) in UNITS:
            return cut(unit), now
        words = kind.split("_")
        if len(words) == 2 and (unit := words[1].lower()) in UNITS:
            start = cut(unit)
            if words[0] == "THIS":
                return start, now
            if words[0] == "LAST":
                return shift(start, -1, unit), start
            if words[0] == "NEXT":
                return shift(start, 1, unit), shift(start, 2, unit)
        if len(words) == 3 and words[1] == "N" and (unit := words[2].lower().removesuffix("s")) in UNITS:
            if words[0] == "NEXT":
                return now, shift(now, n, unit)
            if words[0] == "LAST":
                return shift(now if unit in ("minute", "hour") else cut(unit), -n, unit), now
        raise TimeError(f"unknown time frame {self.type!r}")


#: Shortcuts that shift both ends by one unit.
SHIFTED = {
    "SAME_PERIOD_LAST_YEAR": "year", "SAME_DAY_LAST_YEAR": "year", "TODAY_LAST_YEAR": "year",
    "SAME_PERIOD_LAST_QUARTER": "quarter", "SAME_DAY_LAST_QUARTER": "quarter",
    "SAME_PERIOD_LAST_MONTH": "month", "SAME_DAY_LAST_MONTH": "month", "TODAY_LAST_MONTH": "month",
    "SAME_DAY_LAST_WEEK": "week",
}
YESTERDAYS = {"YESTERDAY_LAST_YEAR": "year", "YESTERDAY_LAST_MONTH": "month", "YESTERDAY_LAST_WEEK": "week"}
SMART_DAYS = 90


def compare_range(kind: str, current: Range, granularity: str | None = None, amount: int = 1, shortcut: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> Range:
    """The period that a comparison looks at."""
    start, end = current
    kind = kind.upper()
    if kind == "TIME_SHIFT_RELATIVE":
        unit = (granularity or "day").lower()
        return shift(start, -amount, unit), shift(end, -amount, unit)
    if kind == "TIME_SHIFT_ABSOLUTE":
        return from_epoch(start_ms), from_epoch(end_ms)
    if kind == "SMART":
        return start - dt.timedelta(days=SMART_DAYS), start
    if kind == "TIME_SHIFT_SHORTCUT":
        name = (shortcut or "PREVIOUS_PERIOD").upper()
        if name == "PREVIOUS_PERIOD":
            return start - (end - start), start
        if name in SHIFTED:
            return shift(start, -1, SHIFTED[name]), shift(end, -1, SHIFTED[name])
        if name in YESTERDAYS:
            unit = YESTERDAYS[name]
            return shift(start - dt.timedelta(days=1), -1, unit), shift(start, -1, unit)
    raise TimeError(f"unknown comparison {kind} {shortcut}")
