"""Plan-time helpers: column order and gating by name, durations, request ranges, configuration of folds."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from chronoloom.functions.frames import DAY, HOUR, MINUTE, SECOND

# Units of duration texts such as "50min", "1h", "365D".
UNITS = {"s": SECOND, "sec": SECOND, "min": MINUTE, "t": MINUTE, "h": HOUR, "hour": HOUR, "d": DAY, "day": DAY, "w": 7 * DAY}


def microseconds(text: str) -> int:
    """A duration text in microseconds."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+?)s?\s*", text)
    if not found or found[2].lower() not in UNITS:
        raise ValueError(f"no duration: {text!r}")
    return round(float(found[1]) * UNITS[found[2].lower()])


def label_of(length: int) -> str:
    """Short name of a duration: 6h, 3d, 50m."""
    for unit, name in ((DAY, "d"), (HOUR, "h"), (MINUTE, "m"), (SECOND, "s")):
        if length % unit == 0:
            return f"{length // unit}{name}"
    return f"{length}us"


def bars_in(length: int | str, bar: int | str) -> int:
    """Whole bars in a duration, rounded up, at least one."""
    a, b = (microseconds(v) if isinstance(v, str) else v for v in (length, bar))
    return max(1, -(-a // b))


def in_order(df: DataFrame, required: Sequence[str], extended: Sequence[str] = (), internal_prefix: str = "_") -> DataFrame:
    """Required columns first, then known extra ones, then the rest without internals."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    lead = [*required, *(c for c in extended if c in df.columns and c not in required)]
    return df.select(*lead, *(c for c in df.columns if c not in lead and not c.startswith(internal_prefix)))


def by_prefix(df: DataFrame, prefixes: Sequence[str], parts: Sequence[str] = ()) -> list[str]:
    """Columns that start with one of the prefixes or contain one of the parts."""
    return [c for c in df.columns if c.startswith(tuple(prefixes)) or any(p in c for p in parts)]


def gated(df: DataFrame, flags: Mapping[str, bool]) -> DataFrame:
    """Drops the columns of every prefix whose flag is false."""
    off = tuple(p for p, on in flags.items() if not on)
    return df.drop(*[c for c in df.columns if off and c.startswith(off)])


def price_suffix(bars: int) -> str:
    """The price features' window for a path of so many bars: 6 and 12 go with 6h, longer ones with 24h."""
    return "6h" if bars <= 12 else "24h"


def first_present(columns: Sequence[str], wanted: Sequence[str]) -> str:
    """The first wanted column that is there, such as the main horizon's or its stand-in."""
    for c in wanted:
        if c in columns:
            return c
    raise ValueError(f"none of {', '.join(wanted)}")


def request_range(start: str | None = None, lookback_days: int | None = None, now: datetime | None = None) -> dict[str, int]:
    """Parameters s and u (epoch seconds) of a series request."""
    until = now or datetime.now(timezone.utc)
    if start:
        since = datetime.fromisoformat(start).replace(tzinfo=timezone.utc)
    elif lookback_days:
        since = until - timedelta(days=lookback_days)
    else:
        raise ValueError("a start or a number of days is needed")
    return {"s": int(since.timestamp()), "u": int(until.timestamp())}


def month_folds(first: str, last: str, train: int = 18, test: int = 3, step: int = 3, most: int = 20) -> list[tuple[str, str, str]]:
    """(start, cut, end) dates of rolling folds in calendar months."""
    def plus(date: datetime, months: int) -> datetime:
        y, m = divmod(date.month - 1 + months, 12)
        last = monthrange(date.year + y, m + 1)[1]  # a month's end stays one
        return date.replace(year=date.year + y, month=m + 1, day=min(date.day, last))

    at, end, out = datetime.fromisoformat(first), datetime.fromisoformat(last), []
    while plus(at, train + test) <= end and len(out) < most:
        out.append(tuple(d.date().isoformat() for d in (at, plus(at, train), plus(at, train + test))))
        at = plus(at, step)
    return out
