"""Column builders for the scalar formulas of feature pipelines. Missing values are NULL, never NaN, inside the library."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def number(x: Column | str) -> Column:
    """Numeric coercion: text that is no number becomes NULL."""
    return finite(_c(x).try_cast("double"))


def clip(x: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds that keep NULL (greatest and least alone would skip it)."""
    x = _c(x)
    y = x if low is None else F.greatest(x, _c(low))
    y = y if high is None else F.least(y, _c(high))
    return F.when(x.isNotNull(), y)


def safe_ratio(x: Column | str, total: Column | str, default: float, eps: float = EPS) -> Column:
    """x / (total + eps) where total exceeds eps, else the default."""
    x, total = _c(x), _c(total)
    return F.when(total.isNull() | x.isNull(), None).when(total > eps, x / (total + eps)).otherwise(F.lit(default))


def divide(x: Column | str, y: Column | str) -> Column:
    """NULL where the divisor is 0."""
    return F.try_divide(_c(x), _c(y))


def log_guarded(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x > 0, F.ln(x))


def log_return_bps(now: Column | str, before: Column | str, ln: Callable[[Column], Column] = F.ln) -> Column:
    """1e4 ln(now / before), NULL unless both are positive."""
    now, before = _c(now), _c(before)
    return 1e4 * ln(F.when((now > 0) & (before > 0), now / before))


def c_ln(x: Column | str) -> Column:
    """Natural logarithm by the C library, NULL unless positive. ``F.ln`` may differ from it in the last bit, which decides the sign of a sum of
    returns that cancel out; this one agrees with engines that use that library, at the price of a pass through Python."""

    def ln(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(ln, "double")(_c(x))


def softplus(x: Column | str) -> Column:
    x = _c(x)
    return F.log1p(F.exp(-F.abs(x))) + clip(x, 0.0)


def squash(x: Column | str, scale: float) -> Column:
    return 1 - F.exp(-_c(x) / scale)


def sigmoid(x: Column | str, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def half_life(age: Column | str, hours: float) -> Column:
    """2^(-age / hours), 0 for a NULL age."""
    return F.coalesce(F.pow(F.lit(2.0), -_c(age) / hours), F.lit(0.0))


def freshness(age: Column | str, free: float, scale: float) -> Column:
    """exp(-max(0, age - free) / scale), 0 for a NULL age."""
    return F.coalesce(F.exp(-clip(_c(age) - free, 0.0) / scale), F.lit(0.0))


def pinball(actual: Column | str, predicted: Column | str, q: float) -> Column:
    e = _c(actual) - _c(predicted)
    return F.when(e.isNotNull(), F.greatest(q * e, (q - 1) * e))


def entropy(probabilities: list[Column], normalised: bool = True, eps: float = EPS) -> Column:
    """-sum p ln(p + eps), divided by ln(n) on demand."""
    from math import log

    total = sum((-(p * F.ln(p + eps)) for p in probabilities), F.lit(0.0))
    return total / log(len(probabilities)) if normalised else total


def is_close_zero(x: Column | str, atol: float = EPS) -> Column:
    return F.abs(_c(x)) <= atol


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def transition(before: Column, after: Column) -> Column:
    """Text of a state change, ``NA`` for a missing state."""
    return F.concat(F.coalesce(before.cast("string"), F.lit("NA")), F.lit("->"), F.coalesce(after.cast("string"), F.lit("NA")))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp (with or without time zone; the session's zone must be UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def last_assignment(default: Column, *assignments: tuple[Column, Column]) -> Column:
    """CASE in which a later condition overrides an earlier one."""
    out = None
    for condition, value in reversed(assignments):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def row_max(*columns: Column) -> Column:
    return F.greatest(*columns)


def row_margin(*columns: Column) -> Column:
    """Largest minus second largest of the non-null values."""
    ordered = F.sort_array(F.filter(F.array(*columns), lambda x: x.isNotNull()), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def row_argmax(names: list[str], columns: list[Column]) -> Column:
    """Name of the largest value, the first one on ties."""
    best = F.greatest(*columns)
    out = F.when(columns[0] == best, names[0])
    for n, c in zip(names[1:], columns[1:], strict=True):
        out = out.when(c == best, n)
    return out
