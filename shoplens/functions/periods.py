"""Time windows (F1-F4, F19-F22).  Every window takes an explicit ``as_of``.

Bounds are computed on the driver from parameters only (never from data or the
wall clock) and enter plans as literals, so Catalyst pushes them into the scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)


def _as_date(d: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    s = str(d).strip()
    return dt.datetime.fromisoformat(s).date() if len(s) > 10 else dt.date.fromisoformat(s)


def _as_datetime(d: dt.date | dt.datetime | str) -> dt.datetime:
    if isinstance(d, dt.datetime):
        return d.replace(tzinfo=None)
    if isinstance(d, dt.date):
        return dt.datetime(d.year, d.month, d.day)
    s = str(d).strip()
    return dt.datetime.fromisoformat(s).replace(tzinfo=None) if len(s) > 10 else dt.datetime.fromisoformat(s + "T00:00:00")


@dataclass(frozen=True)
class Window:
    """Half-open ``[start, end)`` window plus the equal-length previous one."""

    start: dt.datetime
    end: dt.datetime
    prev_start: dt.datetime
    prev_end: dt.datetime
    days: int

    def contains(self, ts: Column | str) -> Column:
        c = F.col(ts) if isinstance(ts, str) else ts
        return (c >= F.lit(self.start)) & (c < F.lit(self.end))

    def contains_prev(self, ts: Column | str) -> Column:
        c = F.col(ts) if isinstance(ts, str) else ts
        return (c >= F.lit(self.prev_start)) & (c < F.lit(self.prev_end))

    def contains_both(self, ts: Column | str) -> Column:
        c = F.col(ts) if isinstance(ts, str) else ts
        return (c >= F.lit(self.prev_start)) & (c < F.lit(self.end))

    @property
    def label_start(self) -> str:
        return self.start.strftime("%Y-%m-%d")

    @property
    def label_end(self) -> str:
        return (self.end - dt.timedelta(seconds=1)).strftime("%Y-%m-%d")

    @property
    def prev_label_start(self) -> str:
        return self.prev_start.strftime("%Y-%m-%d")

    @property
    def prev_label_end(self) -> str:
        return (self.prev_end - dt.timedelta(seconds=1)).strftime("%Y-%m-%d")


def rolling(as_of: dt.date | dt.datetime | str, days: int) -> Window:
    """``days`` whole days ending with the as-of day, and the ones before.

    ``end = midnight(as_of) + 1 day`` so ``days=1`` is the as-of day itself.
    """
    if int(days) < 1:
        raise ValueError("days must be 1 or more")
    end = _as_datetime(_as_date(as_of)) + DAY
    start = end - dt.timedelta(days=int(days))
    return Window(start, end, start - dt.timedelta(days=int(days)), start, int(days))


def previous(w: Window) -> Window:
    """the equal-length window before ``w`` as one of its own."""
    return Window(w.prev_start, w.prev_end, w.prev_start - (w.prev_end - w.prev_start), w.prev_start, w.days)


def inclusive_days(start: str | dt.date, end: str | dt.date) -> Window:
    """``[start, end_date + 1 day)``; ``end`` may be a date or ISO datetime."""
    s = _as_datetime(start)
    e = _as_datetime(_as_date(end)) + DAY
    days = max((e - s).days, 1)
    return Window(s, e, s - (e - s), s, days)


def between_closed(ts: Column | str, start: str | dt.date, end: str | dt.date) -> Column:
    """closed ``BETWEEN start AND end`` at midnight (the legacy report rule)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.between(F.lit(_as_datetime(start)), F.lit(_as_datetime(end)))


def in_range(ts: Column | str, start: str | dt.date, end: str | dt.date, end_mode: str = "inclusive_day") -> Column:
    """F3 (default) or F4 (``end_mode='between'``)."""
    if end_mode == "between":
        return between_closed(ts, start, end)
    return inclusive_days(start, end).contains(ts)


def report_range(kind: str, as_of: dt.date | str) -> tuple[dt.date, dt.date]:
    """weekly = as_of-6..as_of; monthly = first of month..as_of;
    last30 = as_of-29..as_of; daily = the day before as_of."""
    d = _as_date(as_of)
    if kind == "weekly":
        return d - dt.timedelta(days=6), d
    if kind == "monthly":
        return d.replace(day=1), d
    if kind == "last30":
        return d - dt.timedelta(days=29), d
    if kind == "daily":
        y = d - DAY
        return y, y
    raise ValueError(f"unknown report range {kind!r}")


PRESETS = {"7d": 7, "30d": 30, "90d": 90}


def preset(name: str, as_of: dt.date | str, custom: tuple[str, str] | None = None) -> Window | None:
    """7d / 30d / 90d rolling windows, ``all`` (no window) or ``custom``."""
    if name in PRESETS:
        return rolling(as_of, PRESETS[name])
    if name == "all":
        return None
    if name == "custom":
        if not custom:
            raise ValueError("custom preset needs (start, end)")
        return inclusive_days(*custom)
    raise ValueError(f"unknown preset {name!r}")


def current_week(ts: Column | str, as_of: dt.date | str) -> Column:
    """from Monday of the as-of week, up to the end of the as-of day."""
    d = _as_date(as_of)
    monday = d - dt.timedelta(days=d.weekday())
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= F.lit(_as_datetime(monday))) & (c < F.lit(_as_datetime(d) + DAY))
