"""Price context of bars: returns, volatility, range, trend, volatility of volatility, jumps and data quality over several spans.

One select for each family of window frames (all with the same partitioning and order, so one sort serves them), and one pass
for all ranks and robust distances. Column names are fixed values. Results of a span stand where enough of its bars are valid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, HOUR, Keys, at_least, ordered, span
from chronoloom.functions.scalar import EPS, clip, log_return_bps, micros, squash
from chronoloom.operators import ranks
from chronoloom.operators.asof import anchor


@dataclass(frozen=True)
class ContextSettings:
    bar: int = HOUR
    returns: Sequence[int] = (1, 3, 6, 12, 24)  # hours, as are the other spans
    core: Sequence[int] = (1, 6, 24)
    vol_of_vol: Sequence[int] = (6, 24, 48)
    valid_share: float = 0.8
    sigma_span: int = 7 * DAY
    past_span: int = 30 * DAY
    least: int = 20
    outlier: float = 5.0
    jump: float = 5.0
    scale: float = 2.0
    near_zero: float = 1e-8
    blocks: tuple[tuple[int, int], ...] = ((1, 1), (6, 1), (24, 6))  # span, block of it, in hours

    @property
    def quality(self) -> list[int]:
        return sorted({*self.returns, *self.core, *self.vol_of_vol})

    def bars(self, hours: int) -> int:
        return max(1, hours * HOUR // self.bar)


def context_features(df: DataFrame, keys: Keys, ts: str, s: ContextSettings = ContextSettings(), open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """keys, ``time`` and all features of each bar."""
    c, w = F.col, ordered(keys, ts)
    columns = [c(open_), c(high), c(low), c(close)]
    valid = reduce(lambda p, q: p & q, [x > 0 for x in columns]) & (c(high) >= F.greatest(*columns)) & (c(low) <= F.least(*columns))
    df = df.select(*keys, c(ts).alias("time"), *[x.cast("double").alias(n) for x, n in zip(columns, ("_o", "_h", "_l", "_c"), strict=True)], F.coalesce(valid, F.lit(False)).cast("double").alias("_valid"))
    w = ordered(keys, "time")
    frame = lambda hours: span(keys, "time", hours * HOUR)
    df = df.withColumns({"_ret": log_return_bps(c("_c"), F.lag("_c").over(w)), "_gap": F.when(micros("time") - micros(F.lag("time").over(w)) > s.bar, 1).otherwise(0)})
    df = df.withColumn("_prev", F.lag("_ret").over(w))

    # outliers by the robust scale of the returns before
    df = ranks.rolling_quantiles(df, keys, "time", "_prev", {"_q1": 0.25, "_q3": 0.75}, least=s.least, length=s.sigma_span)
    df = df.withColumn("ret_robust_sigma_bps", clip((c("_q3") - c("_q1")) / 1.349, EPS)).withColumn("ret_outlier_z", F.abs("_ret") / (c("ret_robust_sigma_bps") + EPS))
    df = df.withColumn("_outlier", F.when(c("ret_outlier_z") > s.outlier, 1).otherwise(0))

    # data quality
    q: dict[str, Column] = {}
    for h in s.quality:
        obs, expected = F.sum("_valid").over(frame(h)), s.bars(h)
        q |= {
            f"price_obs_count_{h}h": obs, f"price_expected_count_{h}h": F.lit(expected), f"price_missing_ratio_{h}h": clip(1 - obs / expected, 0.0, 1.0),
            f"price_gap_flag_{h}h": F.when((F.max("_gap").over(frame(h)) > 0) | (obs < expected), 1).otherwise(0),
            f"price_outlier_flag_{h}h": F.max("_outlier").over(frame(h)), f"_ok_{h}h": obs >= s.valid_share * expected,
        }
    df = df.withColumns(q)
    where = lambda h, x: F.when(c(f"_ok_{h}h"), x)

    # returns, volatility, range
    df = df.withColumns({f"past_return_{h}h_bps": where(h, log_return_bps(c("_c"), anchor(df, keys, "time", "_c", h * HOUR, int(1.05 * s.bar)))) for h in s.returns})
    f: dict[str, Column] = {}
    for h in s.core:
        squares = F.sum(c("_ret") * c("_ret")).over(frame(h))
        f |= {
            f"realized_vol_{h}h_bps": where(h, F.sqrt(squares)), f"realized_vol_{h}h_per_sqrt_hour_bps": where(h, F.sqrt(squares / h)),
            f"range_width_{h}h_bps": where(h, log_return_bps(F.max("_h").over(frame(h)), F.min("_l").over(frame(h)))),
        }
    df = df.withColumns(f).withColumns({f"range_to_vol_{h}h": c(f"range_width_{h}h_bps") / (c(f"realized_vol_{h}h_bps") + EPS) for h in s.core})
    df = _trend(df, keys, s)
    rv1 = c(f"realized_vol_{s.core[0]}h_bps")
    f = {}
    for h in s.vol_of_vol:
        enough = lambda x, h=h: where(h, at_least(x, rv1, frame(h), max(1, ceil(s.bars(h) * s.valid_share))))
        f |= {f"vol_of_vol_{h}h": enough(F.stddev_pop(rv1).over(frame(h)) / (F.avg(rv1).over(frame(h)) + EPS)), f"vol_of_vol_abs_{h}h": enough(F.stddev_pop(rv1).over(frame(h)))}
    df = _jumps(df.withColumns(f), keys, s)

    # ranks and robust distances over the long past
    df = ranks.span_context(
        df, keys, "time", s.past_span, s.least, {f"_rank_{h}h": f"range_width_{h}h_bps" for h in s.core},
        {f"realized_vol_{h}h_z": f"realized_vol_{h}h_bps" for h in s.core} | {f"vol_of_vol_{h}h_z": f"vol_of_vol_{h}h" for h in s.vol_of_vol},
    )
    df = df.withColumns({f"range_compression_{h}h": clip(1 - c(f"_rank_{h}h"), 0.0, 1.0) for h in s.core} | {"price_feature_time": c("time"), "price_feature_age_min": F.lit(0.0)})
    return df.select([n for n in df.columns if not n.startswith("_")])


def _trend(df: DataFrame, keys: Keys, s: ContextSettings) -> DataFrame:
    """Efficiency, signal to noise, regression of log price on hours, direction, strength and consistency."""
    c, w = F.col, ordered(keys, "time")
    df = df.withColumns({"_y": F.when(c("_c") > 0, F.ln("_c"))})
    df = df.withColumn("_t", F.when(c("_y").isNotNull(), micros("time") / HOUR))
    df = df.withColumn("_t", c("_t") - F.first("_t", True).over(w))
    out: dict[str, Column] = {}
    for h in s.core:
        frame = span(keys, "time", h * HOUR)
        n, ret = F.count("_y").over(frame), c(f"past_return_{h}h_bps")
        sums = {k: F.sum(v).over(frame) for k, v in {"t": c("_t"), "y": c("_y"), "tt": c("_t") * c("_t"), "yy": c("_y") * c("_y"), "ty": c("_t") * c("_y")}.items()}
        df = df.withColumns({"_n": n, "_stt": sums["tt"] - sums["t"] * sums["t"] / n, "_syy": sums["yy"] - sums["y"] * sums["y"] / n, "_sty": sums["ty"] - sums["t"] * sums["y"] / n})
        ok = c(f"_ok_{h}h") & (c("_n") >= 3)
        slope = c("_sty") / (c("_stt") + EPS)
        error = F.sqrt(clip(c("_syy") - slope * c("_sty"), 0.0) / F.greatest(c("_n") - 2, F.lit(1)) / (c("_stt") + EPS))
        moved = F.abs(ret) > s.near_zero
        side = F.when(ret > 0, F.sum(F.when(c("_ret") > 0, 1).otherwise(0)).over(frame)).when(ret < 0, F.sum(F.when(c("_ret") < 0, 1).otherwise(0)).over(frame))
        df = df.withColumns({
            f"trend_slope_{h}h": F.when(ok, slope), f"trend_slope_tstat_{h}h": F.when(ok, slope / (error + EPS)),
            f"trend_r2_{h}h": F.when(ok, clip(c("_sty") * c("_sty") / (c("_stt") * c("_syy") + EPS), 0.0, 1.0)),
            f"trend_efficiency_{h}h": F.when(c(f"_ok_{h}h"), clip(F.abs(ret) / (F.sum(F.abs("_ret")).over(frame) + EPS), 0.0, 1.0)),
            f"trend_snr_{h}h": F.abs(ret) / (c(f"realized_vol_{h}h_bps") + EPS),
            f"trend_direction_{h}h": F.when(~moved, 0.0).otherwise(F.signum(ret)),
            f"bar_direction_align_{h}h": F.when(moved, clip(side / (F.count("_ret").over(frame) + EPS), 0.0, 1.0)),
            f"block_direction_align_{h}h": _blocks(w, ret, moved, s.bars(dict(s.blocks)[h]), max(1, h // dict(s.blocks)[h]), s),
        })
        strength = 0.35 * c(f"trend_efficiency_{h}h") + 0.35 * squash(c(f"trend_snr_{h}h"), s.scale) + 0.30 * squash(F.abs(f"trend_slope_tstat_{h}h"), s.scale)
        agree = 0.40 * c(f"bar_direction_align_{h}h") + 0.40 * c(f"block_direction_align_{h}h") + 0.20 * c(f"trend_r2_{h}h")
        out |= {f"trend_strength_{h}h": clip(strength, 0.0, 1.0), f"trend_consistency_{h}h": clip(agree, 0.0, 1.0)}
    return df.withColumns(out)


def _blocks(w, ret: Column, moved: Column, block: int, count: int, s: ContextSettings) -> Column:  # noqa: ANN001
    """Share of the blocks of a span, those without a move left out, that went the span's way."""
    one = lambda k: log_return_bps(F.lag("_c", k * block).over(w) if k else F.col("_c"), F.lag("_c", (k + 1) * block).over(w))
    known = [F.abs(one(k)) > s.near_zero for k in range(count)]
    n = sum((F.when(v, 1).otherwise(0) for v in known), F.lit(0))
    same = sum((F.when(v & (F.signum(one(k)) == F.signum(ret)), 1).otherwise(0) for k, v in enumerate(known)), F.lit(0))
    return F.when(moved & (n > 0), clip(same / (n + EPS), 0.0, 1.0))


def _jumps(df: DataFrame, keys: Keys, s: ContextSettings) -> DataFrame:
    c = F.col
    df = df.withColumn("_two", F.abs(c("_ret") * c("_prev")))
    z, out = c("ret_outlier_z"), {}
    for h in s.core:
        frame = span(keys, "time", h * HOUR)
        squares, two = F.sum(c("_ret") * c("_ret")).over(frame), F.sum("_two").over(frame)
        key = F.when(c("_ret").isNotNull(), F.struct(F.abs("_ret").alias("a"), (-micros("time")).alias("t")))
        df = df.withColumns({
            f"max_jump_z_{h}h": F.when(c(f"_ok_{h}h"), F.max(z).over(frame)), f"jump_count_{h}h": F.when(c(f"_ok_{h}h"), F.sum(F.when(z > s.jump, 1).otherwise(0)).over(frame)),
            f"jump_ratio_bv_{h}h": F.when(c(f"_ok_{h}h"), clip(clip(squares - pi / 2 * two, 0.0) / (squares + EPS), 0.0, 1.0)),
            f"signed_max_jump_return_{h}h_bps": F.when(c(f"_ok_{h}h"), F.max_by("_ret", key).over(frame)),
        })
        zero = lambda n: F.coalesce(c(n), F.lit(0.0))
        proxy = 0.5 * squash(zero(f"max_jump_z_{h}h"), s.scale) + 0.3 * zero(f"jump_ratio_bv_{h}h") + 0.2 * squash(zero(f"jump_count_{h}h"), s.scale)
        out[f"jump_proxy_{h}h"] = F.when(c(f"_ok_{h}h"), clip(proxy, 0.0, 1.0))
    return df.withColumns(out)
