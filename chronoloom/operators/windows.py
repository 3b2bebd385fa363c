"""Row-window operators. Each returns a Column or the frame with new columns; ``keys`` partition, ``ts`` orders.

Quantiles over long frames are in ``ranks``; short frames (bounded lists) are plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys, at_least, ordered, past, rows
from chronoloom.functions.scalar import clip, divide
from chronoloom.operators import ranks

MAD_SCALE = 1.4826


def nested_mad_z(df: DataFrame, keys: Keys, ts: str, value: str, n: int, min_periods: int, out: str) -> DataFrame:
    """(x - median) / (1.4826 median of |x - the median at that row|), both over the last n rows."""
    df = ranks.nested_deviation(df, keys, ts, value, n, min_periods, "_med", "_mad")
    return df.withColumn(out, divide(F.col(value) - F.col("_med"), MAD_SCALE * F.col("_mad"))).drop("_med", "_mad")


def array_median(a: Column) -> Column:
    """Median of the non-null members of an array, NULL if there are none."""
    s = F.sort_array(F.filter(a, lambda v: v.isNotNull()))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def true_mad(df: DataFrame, keys: Keys, ts: str, value: str, n: int, min_periods: int, out: str) -> DataFrame:
    """Median of |x - the window's own median| over the last n rows; the frame's list is bounded by n."""
    w = rows(keys, ts, n)
    df = df.withColumn("_a", F.collect_list(value).over(w)).withColumn("_m", array_median(F.col("_a")))
    dev = array_median(F.transform("_a", lambda v: F.abs(v - F.col("_m"))))
    return df.withColumn(out, F.when(F.size("_a") >= min_periods, dev)).drop("_a", "_m")


def true_mad_z(df: DataFrame, keys: Keys, ts: str, value: str, n: int, min_periods: int, out: str) -> DataFrame:
    """Robust z against the window's own median and deviation; 0 where it can't be formed."""
    w = rows(keys, ts, n)
    df = true_mad(df.withColumn("_med", F.percentile(value, 0.5).over(w)), keys, ts, value, n, min_periods, "_mad")
    return df.withColumn(out, F.coalesce(divide(F.col(value) - F.col("_med"), MAD_SCALE * F.col("_mad")), F.lit(0.0))).drop("_med", "_mad")


def matured_sigma(df: DataFrame, keys: Keys, ts: str, value: str, lag: int, n: int, min_periods: int, min_expanding: int, out: str) -> DataFrame:
    """Robust scale of values that have matured (lag rows ago and before); else the deviation of all of them."""
    df = df.withColumn("_x", F.lag(value, lag).over(ordered(keys, ts)))
    df = ranks.nested_deviation(df, keys, ts, "_x", n, min_periods, "_med", "_mad")
    every, x = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0), F.col("_x")
    wide = at_least(F.stddev_samp(x).over(every), x, every, min_expanding)
    return df.withColumn(out, F.coalesce(MAD_SCALE * F.col("_mad"), wide)).drop("_x", "_med", "_mad")


def past_sigma(df: DataFrame, keys: Keys, ts: str, value: str, n: int, min_periods: int, length: int, out: str, least: float = 1e-12) -> DataFrame:
    """Robust scale of the values before a row: 1.4826 MAD over n rows (each distance from its own row's median), where it can't be
    formed the interquartile range over ``length`` / 1.349; not below ``least``."""
    df = df.withColumn("_x", F.lag(value).over(ordered(keys, ts)))
    df = ranks.nested_deviation(df, keys, ts, "_x", n, min_periods, "_med", "_mad")
    df = ranks.rolling_quantiles(df, keys, ts, "_x", {"_lo": 0.25, "_hi": 0.75}, least=min_periods, length=length)
    return df.withColumn(out, clip(F.coalesce(MAD_SCALE * F.col("_mad"), (F.col("_hi") - F.col("_lo")) / 1.349), least)).drop("_x", "_med", "_mad", "_lo", "_hi")


def rolling_slope(y: Column, keys: Keys, ts: str, n: int) -> Column:
    """Least-squares slope over the positions 0..n-1 of the last n rows; NULL until the window is full.

    With weights i - (n-1)/2 this is a finite sum of lags, so no sums of large positions cancel.
    """
    w = ordered(keys, ts)
    centre = (n - 1) / 2
    top = sum(((centre - k) * F.lag(y, k).over(w) for k in range(1, n)), centre * y)
    return top / (n * (n * n - 1) / 12)


def extreme_flag(df: DataFrame, keys: Keys, ts: str, level: str, n: int, high: int = 8, low: int = 0, high_reset: int = 4, low_reset: int = 5, out: str = "flag") -> DataFrame:
    """-1 after the last ``high`` without a later ``high_reset``; else +1 after the last ``low`` without a later ``low_reset``; else 0."""
    w = rows(keys, ts, n)
    rn = F.row_number().over(ordered(keys, ts))
    df = df.withColumn("_rn", rn)
    last = lambda v: F.max(F.when(F.col(level) == v, F.col("_rn"))).over(w)
    fresh = lambda a, b: last(a).isNotNull() & (F.coalesce(last(b), F.lit(-1)) < last(a))
    return df.withColumn(out, F.when(fresh(high, high_reset), -1).when(fresh(low, low_reset), 1).otherwise(0)).drop("_rn")


def repeat_suppressed(x: Column, keys: Keys, ts: str, back: int = 3) -> Column:
    """0 where a value equals one of the ``back`` values before it (as they were before suppression)."""
    w = ordered(keys, ts)
    same = [F.coalesce(F.lag(x, k).over(w) == x, F.lit(False)) for k in range(1, back + 1)]
    any_same = same[0]
    for s in same[1:]:
        any_same = any_same | s
    return F.when(any_same, F.lit(0)).otherwise(x)


def rolling_mode(df: DataFrame, keys: Keys, ts: str, value: str, n: int, out: str) -> DataFrame:
    """The most frequent of the last n values; of equally frequent ones that seen first in the window."""
    df = df.withColumn("_a", F.collect_list(value).over(rows(keys, ts, n)))
    count = lambda v: F.size(F.filter("_a", lambda u: u == v))
    ranked = F.transform(F.array_distinct("_a"), lambda v: F.struct((-count(v)).alias("c"), F.array_position("_a", v).alias("p"), v.alias("v")))
    return df.withColumn(out, F.get(F.sort_array(ranked), 0)["v"]).drop("_a")


def interpolated(df: DataFrame, keys: Keys, ts: str, value: str, out: str) -> DataFrame:
    """NULLs between two values are filled on the line of row numbers; the head stays NULL, the tail keeps the last value."""
    w = ordered(keys, ts)
    df = df.withColumn("_rn", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("i"), F.col(value).alias("v")))
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * divide(F.col("_rn") - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    return df.withColumn(out, F.coalesce(F.col(value), line, F.col("_a.v"))).drop("_rn", "_a", "_b")


def block_alignment(df: DataFrame, keys: Keys, ts: str, value: str, block: int, count: int, out: str) -> DataFrame:
    """Share of the last ``count`` blocks of ``block`` rows whose summed value has the sign of the sum over all of them."""
    w = ordered(keys, ts)
    df = df.withColumn("_b", at_least(F.sum(value).over(rows(keys, ts, block)), F.col(value), rows(keys, ts, block), block))
    blocks = [F.lag("_b", k * block).over(w) if k else F.col("_b") for k in range(count)]
    total = sum(blocks[1:], blocks[0])
    agree = sum((F.when(F.signum(b) == F.signum(total), 1).otherwise(0) for b in blocks), F.lit(0))
    return df.withColumn(out, F.when(total.isNotNull(), agree / count)).drop("_b")


def running_share(df: DataFrame, keys: Keys, ts: str, value: str, out: str) -> DataFrame:
    """Sum of all values before a row as a share of the group's total."""
    before = F.coalesce(F.sum(value).over(past(keys, ts)), F.lit(0))
    return df.withColumn(out, divide(before, F.sum(value).over(Window.partitionBy(*keys))))
