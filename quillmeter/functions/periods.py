"""Report periods, on the driver."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

UTC = dt.timezone.utc


@dataclass(frozen=True)
class Period:
    """since (None: all time) to until; until_open says that until itself is outside."""

    since: dt.datetime | None
    until: dt.datetime
    until_open: bool = False

    def label(self) -> str:
        return f"{self.since.date().isoformat() if self.since else 'all time'} to {self.until.date().isoformat()}"


def _parse(text: str, end: bool) -> tuple[dt.datetime, bool]:
    """A date's beginning (or, as an end, the next midnight, which is outside) or an RFC 3339 time."""
    try:
        day = dt.date.fromisoformat(text) if len(text) == 10 else None
        at = dt.datetime.fromisoformat(text) if day is None else dt.datetime.combine(day, dt.time(), UTC)
    except ValueError as e:
        raise ValueError(f"neither a date nor a time: {text!r}") from e
    if day is not None:
        return (at + dt.timedelta(days=1), True) if end else (at, False)
    if at.tzinfo is None:
        raise ValueError(f"a time needs an offset: {text!r}")
    return at.astimezone(UTC), False


def range_period(since: str | None, until: str | None, now: dt.datetime) -> Period:
    """The period of a from/to pair; to is now at the latest. A pair that is inverted is an error; a lone from in
    the future gives the empty period now to now."""
    a = _parse(since, False)[0] if since else None
    b, is_open = _parse(until, True) if until else (now, False)
    if a and until and (a > b or (a == b and is_open)):
        raise ValueError("the range ends before it begins")
    if b > now:
        b, is_open = now, False
    return Period(min(a, b) if a else None, b, is_open)


def last_days(days: int, now: dt.datetime) -> Period:
    return Period(now - dt.timedelta(days=days), now)


WEEKLY, MONTHLY = 7, 30
