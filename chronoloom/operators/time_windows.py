"""Operators over time spans (t - d, t]: volatility, range, trend, jumps, data quality, past ranks, outlier compression."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.frames import HOUR, Keys, at_least, ordered, span
from chronoloom.functions.scalar import clip, divide, log_return_bps, micros, squash
from chronoloom.operators import ranks


def base_returns(df: DataFrame, keys: Keys, ts: str, price: str, out: str = "ret", ln: Callable[[Column], Column] = F.ln) -> DataFrame:
    """Log return in basis points from row to row; where the sign of sums counts, with ``scalar.c_ln``."""
    return df.withColumn("_before", F.lag(price).over(ordered(keys, ts))).withColumn(out, log_return_bps(F.col(price), F.col("_before"), ln)).drop("_before")


def realised_volatility(x: Column, keys: Keys, ts: str, length: int, per_hour: bool = False) -> Column:
    """sqrt of the sum of squared returns of the span, on demand per root hour."""
    rv = F.sqrt(F.sum(x * x).over(span(keys, ts, length)))
    return rv / (length / HOUR) ** 0.5 if per_hour else rv


def range_width(high: str, low: str, keys: Keys, ts: str, length: int) -> Column:
    w = span(keys, ts, length)
    return log_return_bps(F.max(high).over(w), F.min(low).over(w))


def rolling_trend(df: DataFrame, keys: Keys, ts: str, price: str, length: int, prefix: str) -> DataFrame:
    """Least squares of log price on elapsed hours over a span of at least 3 values: slope, r2, t statistic."""
    w = span(keys, ts, length)
    df = df.withColumn("_y", F.when(F.col(price) > 0, F.ln(price))).withColumn("_x", F.when(F.col("_y").isNotNull(), micros(ts) / HOUR))
    df = df.withColumn("_x", F.col("_x") - F.first("_x", True).over(ordered(keys, ts)))
    n = F.count("_y").over(w)
    s = {k: F.sum(v).over(w) for k, v in {"x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") ** 2, "yy": F.col("_y") ** 2, "xy": F.col("_x") * F.col("_y")}.items()}
    df = df.withColumns({"_n": n, "_sxx": s["xx"] - s["x"] * s["x"] / n, "_sxy": s["xy"] - s["x"] * s["y"] / n, "_syy": s["yy"] - s["y"] * s["y"] / n})
    ok = (F.col("_n") >= 3) & (F.col("_sxx") > 0)
    slope = F.when(ok, F.col("_sxy") / F.col("_sxx"))
    r2 = F.when(ok, clip(F.coalesce(F.try_divide(F.col("_sxy") ** 2, F.col("_sxx") * F.col("_syy")), F.lit(0.0)), 0.0, 1.0))
    df = df.withColumns({f"{prefix}_slope": slope, f"{prefix}_r2": r2})
    t = F.signum(f"{prefix}_slope") * F.sqrt(F.col(f"{prefix}_r2") * (F.col("_n") - 2) / (1 - F.col(f"{prefix}_r2") + 1e-9))
    return df.withColumn(f"{prefix}_t", t).drop("_x", "_y", "_n", "_sxx", "_sxy", "_syy")


def direction_alignment(x: str, keys: Keys, ts: str, length: int) -> Column:
    """Share of the returns of a span that have the sign of their sum."""
    w = span(keys, ts, length)
    up, down, n = (F.sum(F.when(c, 1).otherwise(0)).over(w) for c in (F.col(x) > 0, F.col(x) < 0, F.col(x).isNotNull()))
    total = F.sum(x).over(w)
    return F.try_divide(F.when(total > 0, up).when(total < 0, down).otherwise(0).cast("double"), F.when(total.isNotNull(), n))


def trend_composite(df: DataFrame, keys: Keys, ts: str, ret: str, length: int, prefix: str) -> DataFrame:
    """Efficiency |sum| / sum of |r|, signal to noise, and strength of a trend whose t statistic is in ``{prefix}_t``."""
    w = span(keys, ts, length)
    x = F.col(ret)
    total, path, noise = F.sum(x).over(w), F.sum(F.abs(x)).over(w), F.sqrt(F.sum(x * x).over(w))
    df = df.withColumns({f"{prefix}_eff": divide(F.abs(total), path), f"{prefix}_snr": divide(F.abs(total), noise)})
    strength = 0.35 * F.col(f"{prefix}_eff") + 0.35 * squash(F.col(f"{prefix}_snr"), 2.0) + 0.30 * squash(F.abs(f"{prefix}_t"), 2.0)
    return df.withColumn(f"{prefix}_strength", strength)


def vol_of_vol(rv: str, keys: Keys, ts: str, length: int, min_count: int) -> Column:
    """Population deviation of realised volatility over its mean."""
    w, x = span(keys, ts, length), F.col(rv)
    return at_least(divide(F.stddev_pop(x).over(w), F.avg(x).over(w)), x, w, min_count)


def jump_features(df: DataFrame, keys: Keys, ts: str, ret: str, sigma: str, length: int, threshold: float, prefix: str) -> DataFrame:
    """Largest |r| / sigma, number above the threshold, share of variance beyond bipower variation, and their composite."""
    w = span(keys, ts, length)
    x = F.col(ret)
    df = df.withColumn("_z", divide(F.abs(x), F.col(sigma))).withColumn("_bv", F.abs(x * F.lag(x).over(ordered(keys, ts))))
    rv, bv = F.sum(x * x).over(w), pi / 2 * F.sum("_bv").over(w)
    df = df.withColumns({
        f"{prefix}_max_z": F.max("_z").over(w),
        f"{prefix}_count": F.sum(F.when(F.col("_z") > threshold, 1).otherwise(0)).over(w),
        f"{prefix}_ratio": clip(divide(rv - bv, rv), 0.0, 1.0),
    })
    proxy = 0.5 * squash(F.col(f"{prefix}_max_z"), threshold) + 0.3 * F.coalesce(f"{prefix}_ratio", F.lit(0.0)) + 0.2 * squash(F.col(f"{prefix}_count"), 2.0)
    return df.withColumn(f"{prefix}_proxy", proxy).drop("_z", "_bv")


def signed_max_abs(x: str, keys: Keys, ts: str, length: int) -> Column:
    """The value of largest absolute size in the span, the first one on ties."""
    w = span(keys, ts, length)
    key = F.struct(F.abs(x).alias("a"), (-micros(ts)).alias("t"))
    return F.max_by(x, F.when(F.col(x).isNotNull(), key)).over(w)


def data_quality(df: DataFrame, keys: Keys, ts: str, value: str, length: int, bar: int, prefix: str) -> DataFrame:
    """Observed values of a span, share missing of the expected ones, gap flag (also during warm-up) and valid-window flag."""
    w, expected = span(keys, ts, length), length // bar
    df = df.withColumn(f"{prefix}_obs", F.count(value).over(w))
    missing = clip(1 - F.col(f"{prefix}_obs") / expected, 0.0, 1.0)
    return df.withColumns({
        f"{prefix}_missing": missing,
        f"{prefix}_gap": F.when(F.col(f"{prefix}_obs") < expected, 1).otherwise(0),
        f"{prefix}_valid": F.when(F.col(f"{prefix}_obs") >= 0.8 * expected, 1).otherwise(0),
    })


def past_percentile(df: DataFrame, keys: Keys, ts: str, value: str, length: int, min_periods: int, out: str) -> DataFrame:
    """(average rank - 1) / (count - 1) of the current value within the span."""
    return ranks.past_ranks(df, keys, ts, value, length, min_periods, out, strict=False)


def past_midrank(df: DataFrame, keys: Keys, ts: str, value: str, length: int, min_obs: int, out: str) -> DataFrame:
    """(number below + number not above) / 2n among the values of [t - d, t), the current one excluded."""
    return ranks.past_ranks(df, keys, ts, value, length, min_obs, out, strict=True)


def iqr_z(df: DataFrame, keys: Keys, ts: str, value: str, length: int, min_periods: int, out: str, bound: float = 5.0, scale: float = 1.349, eps: float = 0.0) -> DataFrame:
    """(x - median) / (IQR / scale + eps) with both from values before the current row, clipped."""
    df = ranks.past_quantiles(df, keys, ts, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, length, min_periods)
    z = divide(F.col(value) - F.col("_q2"), (F.col("_q3") - F.col("_q1")) / scale + eps)
    return df.withColumn(out, clip(z, -bound, bound)).drop("_q1", "_q2", "_q3")


def train_or_past_z(df: DataFrame, keys: Keys, ts: str, value: str, train: Column | None, length: int, min_periods: int, out: str, bound: float = 5.0, eps: float = 1e-12) -> DataFrame:
    """(x - median) / (IQR + eps): of the key's training rows where it has values there, else of the values before the row."""
    past = iqr_z(df, keys, ts, value, length, min_periods, out, bound, 1.0, eps)
    if train is None:
        return past
    fit = df.where(train).groupBy(*keys).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("_fit"))
    q = lambda k: F.get("_fit", F.lit(k))
    z = clip((F.col(value) - q(1)) / (q(2) - q(0) + eps), -bound, bound)
    return past.join(fit, list(keys), "left").withColumn(out, F.when(q(1).isNull(), F.col(out)).otherwise(z)).drop("_fit")


def outlier_cap(df: DataFrame, keys: Keys, ts: str, value: str, length: int, out: str, k: float = 3.0) -> DataFrame:
    """Values above q3 + k IQR are compressed to the stretch of one more IQR above the cap, by their place up to the maximum."""
    df = ranks.rolling_quantiles(df, keys, ts, value, {"_q1": 0.25, "_q3": 0.75, "_m": 1.0}, length=length)
    x, q1, q3 = F.col(value), F.col("_q1"), F.col("_q3")
    iqr, cap = q3 - q1, q3 + k * (q3 - q1)
    packed = F.coalesce(q3 + (k + 1) * iqr * divide(x - q3, F.col("_m") - q3), cap)
    return df.withColumn(out, F.when(x > cap, packed).otherwise(x)).drop("_q1", "_q3", "_m")
