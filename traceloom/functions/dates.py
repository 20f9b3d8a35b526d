"""Time scopes and calendar functions (FLT-12 to FLT-15, DAT-1 to DAT-3)."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

HOURS_MOST = 200_000  # fixed value
UNITS = {"h": 3_600_000, "m": 60_000, "d": 86_400_000}


def day_start(day: date, zone: ZoneInfo) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=zone).timestamp() * 1000)


def instant(value: str | int, zone: str = "UTC", end: bool = False) -> int:
    """FLT-14: Unix ms from ms, ISO 8601 with or without fraction and offset, or a date; a date as an end is the next
    midnight."""
    if isinstance(value, int):
        return value
    s = value.strip()
    if re.fullmatch(r"-?\d{9,}", s):
        return int(s)
    z = ZoneInfo(zone)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        d = date.fromisoformat(s)
        return day_start(d + timedelta(days=int(end)), z)
    t = datetime.fromisoformat(s.replace("Z", "+00:00").replace("/", "-"))
    return int((t if t.tzinfo else t.replace(tzinfo=z)).timestamp() * 1000)


def week_bounds(year: int, week: int, zone: ZoneInfo) -> tuple[int, int]:
    """DAT-3: bounds of an ISO week; a week that the year doesn't have is an error."""
    monday = date.fromisocalendar(year, week, 1)
    return day_start(monday, zone), day_start(monday + timedelta(days=7), zone)


def period(text: str, now: int, zone: str = "UTC") -> tuple[int, int]:
    """FLT-12: today, yesterday, this_week, last_week, a date, A..B with B included, YYYY-Www, or <N>h, m, d."""
    z = ZoneInfo(zone)
    today = datetime.fromtimestamp(now / 1000, z).date()
    monday = today - timedelta(days=today.weekday())
    span = lambda a, b: (day_start(a, z), day_start(b, z))
    s = text.strip().lower()
    named = {"today": (today, today + timedelta(1)), "yesterday": (today - timedelta(1), today), "this_week": (monday, monday + timedelta(7)), "last_week": (monday - timedelta(7), monday)}
    if s in named:
        return span(*named[s])
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})", s):
        a, b = map(date.fromisoformat, m.groups())
        if b < a:
            raise ValueError("the period ends before it begins")
        return span(a, b + timedelta(1))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        a = date.fromisoformat(s)
        return span(a, a + timedelta(1))
    if m := re.fullmatch(r"(\d{4})-w(\d{2})", s):
        return week_bounds(int(m[1]), int(m[2]), z)
    if (m := re.fullmatch(r"(\d+)([hmd])", s)) and 1 <= int(m[1]) <= 100_000:
        return now - int(m[1]) * UNITS[m[2]], now
    raise ValueError(f"no period: {text}")


def scope(now: int, start=None, end=None, period_: str | None = None, default: str = "24h", floor: int | None = None, zone: str = "UTC") -> tuple[int, int, bool]:
    """FLT-13: bounds asked for, cut to the begin of a grant (then the flag is set). Bounds and a period at once, or an
    end that isn't behind the start, are errors."""
    if period_ is not None and (start is not None or end is not None):
        raise ValueError("give bounds or a period")
    if start is not None or end is not None:
        hi = instant(end, zone, True) if end is not None else now
        lo = instant(start, zone) if start is not None else period(default, hi, zone)[0]
    else:
        lo, hi = period(period_ or default, now, zone)
    if hi <= lo:
        raise ValueError("the end must be behind the start")
    cut = floor is not None and lo < floor
    return (max(lo, floor) if cut else lo), hi, cut


def single_day(lo: int, hi: int, zone: str = "UTC") -> date | None:
    """FLT-15."""
    z = ZoneInfo(zone)
    d = datetime.fromtimestamp(lo / 1000, z).date()
    return d if (lo, hi) == (day_start(d, z), day_start(d + timedelta(1), z)) else None


def single_week(lo: int, hi: int, zone: str = "UTC") -> tuple[int, int] | None:
    z = ZoneInfo(zone)
    iso = datetime.fromtimestamp(lo / 1000, z).date().isocalendar()
    return (iso.year, iso.week) if (lo, hi) == week_bounds(iso.year, iso.week, z) else None


def hour_bounds(lo: int, hi: int) -> list[int]:
    """DAT-3: full hours within lo .. hi."""
    if (hi - lo) // 3_600_000 > HOURS_MOST:
        raise ValueError("too many hours")
    return list(range(-(-lo // 3_600_000) * 3_600_000, hi, 3_600_000))


def day_text(ms: Column) -> Column:
    """DAT-1, in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def bucket_label(ms: Column, size: str) -> Column:
    """DAT-2: label of the hour, day or ISO week of a time."""
    t = F.timestamp_millis(ms)
    if size == "hour":
        return F.date_format(t, "yyyy-MM-dd HH:00")
    if size == "day":
        return F.date_format(t, "yyyy-MM-dd")
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t))


def weekday(ms: Column) -> Column:
    """DAT-3: 1 is Monday."""
    return (F.weekday(F.timestamp_millis(ms)) + 1).cast("int")


def now_ms() -> int:
    return int(datetime.now(timezone.utc).timestamp() * 1000)
