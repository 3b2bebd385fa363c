"""Window specifications over rows and over time, and the minimum number of values that a result needs.

All take the partition keys first, so that a series of many entities is spread over the cluster by its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from chronoloom.functions.scalar import micros

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND
Keys = Sequence[str]


def ordered(keys: Keys, ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def rows(keys: Keys, ts: str, n: int, end: int = 0) -> WindowSpec:
    """The last n rows, of which the newest is ``end`` rows from the current one."""
    return ordered(keys, ts).rowsBetween(end - n + 1, end)


def past(keys: Keys, ts: str) -> WindowSpec:
    """All rows strictly before the current one."""
    return ordered(keys, ts).rowsBetween(Window.unboundedPreceding, -1)


def running(keys: Keys, ts: str) -> WindowSpec:
    return ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)


def span(keys: Keys, ts: str, length: int) -> WindowSpec:
    """The time span (t - length, t], open on the left; ``length`` in microseconds."""
    return Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(1 - length, 0)


def at_least(result: Column, value: Column, window: WindowSpec, n: int) -> Column:
    """The result where the window holds n non-null values or more."""
    return F.when(F.count(value).over(window) >= n, result)
