"""Composed stages: the canonical family of two sides, the regime model's observation features and its application, source rows on bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import DAY, Keys, at_least, ordered, rows
from chronoloom.operators import asof, islands, ranks, recursive as rc, regime as rg, scans, time_windows as tw, windows as wn
from chronoloom.operators.checks import Family
from chronoloom.operators.resample import collapse_to_source, keep_last
from chronoloom.sources.readers import typed_series, with_aliases


def clean_frame(
    df: DataFrame, keys: Keys, ts: str, raw: tuple[str, str] = ("raw_long", "raw_short"), f: Family = Family(), *,
    aliases: Mapping[str, str] | None = None, start: str | None = None, days: int = 180, factor: float = 3.0, tie: Column | None = None, active: str = "active",
) -> DataFrame:
    """The clean two-sided frame: keys, time, price, both sides, their total, difference, share and dominance, and whether there was any.

    Columns decide what is done. A frame with the ``raw`` sides gets them capped over the last ``days`` (values above the third quartile and
    ``factor`` interquartile ranges are compressed) and gaps filled on the line between their neighbours; one with the clean sides (``long_side`` and
    ``short_side`` of ``f``) keeps them; any other is an error. ``aliases`` (their name: ours) come first. Rows without a time, or before ``start``, go; of
    rows of one time the last by ``tie`` stays; text that is no number counts as missing. Sides are not below 0. A side stays NULL before its first
    value: then total and difference are NULL, the share is 0.5, the dominance 0 and nothing is active.
    """
    df = with_aliases(df, aliases or {})
    sides, have = (f.long_side, f.short_side), set(df.columns)
    given = raw if {ts, f.price, *raw} <= have else sides if {ts, f.price, *sides} <= have else None
    if given is None:
        raise ValueError(f"neither a raw frame ({', '.join((ts, f.price, *raw))}) nor a clean one ({', '.join((ts, f.price, *sides))})")
    df = typed_series(df.select(*keys, ts, f.price, *given, *([tie.alias("_tie")] if tie is not None else [])), ts, [f.price, *given], keys, F.col("_tie") if tie is not None else None)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    for source, out in zip(given, sides, strict=True):
        if given == raw:
            df = wn.interpolated(tw.outlier_cap(df, keys, ts, source, days * DAY, out, factor), keys, ts, out, out)
        df = df.withColumn(out, sc.clip(out, 0.0))
    l, s, total = F.col(f.long_side), F.col(f.short_side), F.col(f.total)
    df = df.withColumns({f.total: l + s, f.difference: l - s})
    return df.select(
        *keys, ts, f.price, *sides, f.total, f.difference, F.coalesce(sc.safe_ratio(l, total, 0.5), F.lit(0.5)).alias(f.share),
        F.coalesce(sc.safe_ratio(F.col(f.difference), total, 0.0), F.lit(0.0)).alias(f.dominance), F.when(total > 0, 1).otherwise(0).alias(active),
    )


def delta_case(a: Column, b: Column, da: Column, db: Column) -> Column:
    """How two sides moved and which is larger: L, up or down, S, up or down, then the larger side (S on ties); ``None`` where one stands still."""
    way = lambda d: F.when(d > 0, "U").when(d < 0, "D")
    larger = F.when(a > b, "L").when(a <= b, "S")
    return F.coalesce(F.concat(F.lit("L"), way(da), F.lit("S"), way(db), larger), F.lit("None"))


def canonical_family(df: DataFrame, keys: Keys, ts: str, long_side: str, short_side: str, *, history: int = 17280, level: int = 6, difference_span: float = 16, share_span: float = 12) -> DataFrame:
    """Both sides smoothed by the trailing wavelet and the level filter, their sum, difference and shares, averages of these, and the case of their moves."""
    sides = {"long_level": long_side, "short_level": short_side}
    parts = [p for out, side in sides.items() for p in (rc.Trend([side], [f"_{out}"], history, level), scans.Level([f"_{out}"], [out]))]
    df = scans.scan(df, keys, [ts], parts).drop(*[f"_{out}" for out in sides])
    l, s, w = F.col("long_level"), F.col("short_level"), ordered(keys, ts)
    df = df.withColumns({"total_level": l + s, "diff_level": l - s, "delta_long": l - F.lag(l).over(w), "delta_short": s - F.lag(s).over(w)})
    df = df.withColumns({
        "share": sc.safe_ratio(l, "total_level", 0.5), "dominance_share": sc.safe_ratio("diff_level", "total_level", 0.0), "delta_case": delta_case(l, s, F.col("delta_long"), F.col("delta_short")),
    })
    return scans.scan(df, keys, [ts], [scans.Average([x], [f"{name}_smooth"], 2 / (span + 1)) for x, name, span in (("diff_level", "diff", difference_span), ("share", "share", share_span))])


def arcsinh_scaled(df: DataFrame, keys: Keys, value: str, out: str) -> DataFrame:
    """arcsinh of a value over the median of all absolute values of its key: for descriptions, it knows the whole series."""
    scale = df.groupBy(*keys).agg(F.percentile(F.abs(value), 0.5).alias("_scale"))
    x = F.col(value) / (F.col("_scale") + sc.EPS)
    return df.join(scale, list(keys), "left").withColumn(out, F.signum(x) * F.asinh(F.abs(x))).drop("_scale")  # asinh itself overflows below -1e8


@dataclass(frozen=True)
class ObservationSettings:
    """How the regime model sees a two-sided series."""

    lookback: int = 365 * DAY
    least: int = 5000
    clip: float = 1e-4
    span: float | None = None  # of an average over both sides first


#: Features of the regime model, in the order of its means.
FEATURES = ("z_share", "z_diff", "z_total")


def observation_features(df: DataFrame, keys: Keys, ts: str, long_side: str, short_side: str, s: ObservationSettings = ObservationSettings()) -> DataFrame:
    """Normal scores of the mid-ranks of share, difference and total among the values before, and whether both sides are empty.

    Scores are NULL until a key has ``least`` earlier values."""
    l, r = long_side, short_side
    if s.span and s.span >= 2:
        df = rc.ema(rc.ema(df, keys, [ts], l, s.span, "_l"), keys, [ts], r, s.span, "_r")
        l, r = "_l", "_r"
    total = F.col(l) + F.col(r)
    df = df.withColumns({"_share": F.col(l) / (total + sc.EPS), "_diff": F.col(l) - F.col(r), "_total": total})
    df = ranks.past_midranks(df, keys, ts, {f"_rank{k}": c for k, c in enumerate(("_share", "_diff", "_total"))}, s.lookback, s.least)
    df = rg.with_probits(df, {z: f"_rank{k}" for k, z in enumerate(FEATURES)}, s.clip).withColumn("is_zero", (F.col("_total") == 0).cast("int"))
    return df.drop("_l", "_r", "_share", "_diff", "_total", *[f"_rank{k}" for k in range(3)])


#: Role of each state, from the strongest upward pressure to the strongest downward pressure:
#: name, side, pressure, direction, severity.
ROLES = (
    ("short_liq_strong", "short_liquidation", "up", 1, 2),
    ("short_liq_mild", "short_liquidation", "up", 1, 1),
    ("balanced_liq", "balanced", "neutral", 0, 0),
    ("long_liq_mild", "long_liquidation", "down", -1, 1),
    ("long_liq_strong", "long_liquidation", "down", -1, 2),
)


def with_roles(df: DataFrame, state: str) -> DataFrame:
    """Name, side, pressure, direction and severity of a state counted from 1; NULL for unknown states."""
    names = ("state_name", "state_side", "state_pressure", "state_direction", "state_severity")
    table = lambda k: F.create_map(*[x for i, role in enumerate(ROLES, 1) for x in (F.lit(i), F.lit(role[k]))])
    return df.withColumns({n: F.try_element_at(table(k), F.col(state).cast("int")) for k, n in enumerate(names)})


def posterior_summary(df: DataFrame, posteriors: Sequence[str]) -> DataFrame:
    """Probability of upward, no and downward pressure, their difference, entropy and the largest probability. The posteriors are in the order of ``ROLES``."""
    p = [F.col(c) for c in posteriors]
    part = lambda way: sum((x for x, role in zip(p, ROLES, strict=True) if role[2] == way), F.lit(0.0))
    return df.withColumns({"p_up": part("up"), "p_neutral": part("neutral"), "p_down": part("down")}).withColumns({
        "dir_expect": F.col("p_up") - F.col("p_down"), "state_entropy": sc.entropy(p, normalised=False), "state_maxp": F.greatest(*p),
    })


def age_in_state(df: DataFrame, keys: Keys, ts: str, state: str, out: str) -> DataFrame:
    """Rows since the state was entered, 0 in the first; rows without a state have none and do not end it."""
    known = F.col(state).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(ts)
    df = df.withColumn("_new", F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(out, F.when(known, F.row_number().over(Window.partitionBy(*keys, known, "_run").orderBy(ts)) - 1)).drop("_new", "_run")


def regime_parts(model: rg.Gaussians, confirm: int = 2, switch: float = 0.6, least_rows: int = 1) -> list[scans.Recurrence]:
    """The model's filter (``_q0`` ...) and the state that is held (``_held``), in one pass."""
    return [rg.filter_of(FEATURES, model, "_q"), scans.Debounce(["state", "confidence"], ["_held"], confirm, switch, least_rows)]


def apply_regime(
    df: DataFrame, keys: Keys, source_ts: str, ts: str, long_side: str, short_side: str, model: rg.Gaussians, s: ObservationSettings = ObservationSettings(), *, confirm: int = 2, switch: float = 0.6, least_rows: int = 1
) -> DataFrame:
    """The regime of every row, decided on the clock of its source: each source time is one observation (its latest row), which is
    ranked, scored, filtered and debounced; the rows then take the state, the summary and the role of their source time.

    Warm-up observations give no state. ``model`` has five states in the order of ``ROLES``; states count from 1."""
    posteriors = [f"p_state_{k}" for k in range(1, len(ROLES) + 1)]
    one = collapse_to_source(df.select(*keys, source_ts, ts, F.col(long_side).alias("_long"), F.col(short_side).alias("_short")), keys, source_ts, ts)
    seen = observation_features(one, keys, source_ts, "_long", "_short", s).dropna(subset=list(FEATURES))
    seen = scans.scan(seen, keys, [source_ts], regime_parts(model, confirm, switch, least_rows))
    seen = seen.withColumn("_held", F.col("_held").cast("int")).withColumn("_held_confidence", F.get(F.array(*[f"_q{k}" for k in range(len(ROLES))]), F.col("_held")))
    seen = seen.select(*keys, source_ts, (F.col("_held") + 1).alias("state"), F.col("_held_confidence").alias("state_confidence"), *[F.col(f"_q{k}").alias(p) for k, p in enumerate(posteriors)])
    seen = age_in_state(posterior_summary(seen, posteriors), keys, source_ts, "state", "age_in_state_source")
    rows = df.join(seen, [*keys, source_ts], "left")
    return with_roles(age_in_state(rows, keys, ts, "state", "age_in_state"), "state")


def on_bars(bars: DataFrame, source: DataFrame, keys: Keys, source_ts: str, order: Sequence[str], age: str, direction: str, reliability: str, sizes: Mapping[str, str], main: str, *, free: float = 60.0, scale: float = 60.0) -> DataFrame:
    """Source rows on the bars that name their time: only the freshness is formed anew, from the bar's ``age``.

    Of source rows of one time the last by ``order`` counts. ``sizes`` (output: column of the source) become signed, weighted
    expectations, 0 where the bar has no source; ``main`` names the output repeated as ``main_size``."""
    taken = [direction, reliability, *sizes.values()]
    last = keep_last(source.select(*dict.fromkeys([*keys, source_ts, *order, *taken])), [*keys, source_ts], order).select(*keys, source_ts, *taken)
    out = bars.join(last, [*keys, source_ts], "left").withColumn("freshness", sc.freshness(age, free, scale))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = out.withColumn("bar_reliability", zero(reliability) * F.col("freshness"))
    out = out.withColumns({o: zero(direction) * zero(c) * F.col("bar_reliability") for o, c in sizes.items()})
    return out.withColumn("main_size", F.col(main))


def asof_median_bars(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], factor: float = 1.5, age: str = "age") -> DataFrame:
    """As-of join whose tolerance is ``factor`` times the key's median step of the right side."""
    at = sc.micros(on)
    step = right.select(*by, at.alias("_at")).distinct()
    step = step.withColumn("_step", F.col("_at") - F.lag("_at").over(Window.partitionBy(*by).orderBy("_at")))
    most = step.groupBy(*by).agg((F.percentile("_step", 0.5) * factor).alias("_most"))
    found = asof.asof_join(left, right, on, by, values, age=age).join(most, list(by), "left")
    near = F.col(age) <= F.col("_most")
    return found.withColumns({c: F.when(near, F.col(c)) for c in (*values, age)}).drop("_most")


def state_semantics(df: DataFrame, state: str, columns: Sequence[str]) -> DataFrame:
    """Rows and share of each state, and the mean and median of each column in it."""
    each = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, 0.5)))]
    counts = df.groupBy(state).agg(F.count("*").alias("n"), *each)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def evidence_summary(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """Mean, median, 90th percentile and share of missing values of each column in each split, one row each."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.col(split), F.inline(each)).withColumn("v", sc.finite("v"))
    return long.groupBy(split, "feature").agg(F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.9).alias("p90"), F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"))


def flag_counts(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """How often each flag holds in each group, one row for each, zeros included."""
    each = F.array(*[F.struct(F.lit(n).alias("flag"), F.coalesce(c, F.lit(False)).cast("long").alias("v")) for n, c in flags.items()])
    return df.select(*keys, F.inline(each)).groupBy(*keys, "flag").agg(F.sum("v").alias("n"), F.avg("v").alias("share"))


@dataclass(frozen=True)
class PriceSettings:
    """Spans in minutes and noises of ``liquidity_price``; the defaults are the published ones."""

    spike: int = 1440
    kama: tuple[int, int] = (2, 30)
    gaussian: int = 130
    momentum: int = 180
    momentum_vol: int = 720
    noises: tuple[float, float, float] = (1e-6, 1e-7, 1e-4)  # level, slope, measurement
    vol: tuple[int, int] = (360, 1440)
    least_weight: float = 0.30
    gamma: float = 3.0


def liquidity_price(df: DataFrame, keys: Keys, ts: str, price: str, long_side: str, short_side: str, bar_minutes: int, s: PriceSettings = PriceSettings()) -> DataFrame:
    """Nine features of the price and two sides: for each side the spike over its adaptive average and velocity and acceleration of its smoothed logarithm
    (an hour), the price's trend pressure, its Kalman slope (an hour), and a blend of short and long volatility.

    Negative sides count as 0; spans are whole bars, at least one. Keys' rows are all decision bars, one after the other."""
    bars = lambda minutes: max(round(minutes / bar_minutes), 1)
    w, c, hour = ordered(keys, ts), F.col, 60.0 / bar_minutes
    names = df.columns
    df = df.withColumns({"_long": F.greatest(sc.finite(c(long_side).cast("double")), F.lit(0.0)), "_short": F.greatest(sc.finite(c(short_side).cast("double")), F.lit(0.0)), "_log": F.ln(F.greatest(sc.finite(c(price).cast("double")), F.lit(sc.EPS)))})
    df = df.withColumns({"_ret": c("_log") - F.lag("_log").over(w), "_mom": c("_log") - F.lag("_log", bars(s.momentum)).over(w), "_ll": F.log1p("_long"), "_ls": F.log1p("_short")})
    for side in ("long", "short"):
        df = rc.kama(df, keys, ts, f"_{side}", bars(s.spike), f"_kama_{side}", *s.kama, from_first=True)
        df = rc.spike(df, keys, ts, f"_{side}", f"_kama_{side}", f"{side}_spike", sc.EPS)
    smooth = lambda x: rc.gaussian_fir(c(x), keys, ts, bars(s.gaussian)) if bars(s.gaussian) > 1 else c(x)
    df = df.withColumns({"_gl": smooth("_ll"), "_gs": smooth("_ls")})
    df = df.withColumns({f"{side}_velocity": (c(x) - F.lag(x).over(w)) * hour for side, x in (("long", "_gl"), ("short", "_gs"))})
    df = df.withColumns({f"{side}_acceleration": (c(f"{side}_velocity") - F.lag(f"{side}_velocity").over(w)) * hour for side in ("long", "short")})
    vol = lambda n: at_least(F.stddev_samp("_ret").over(rows(keys, ts, n)), c("_ret"), rows(keys, ts, n), min(n, max(3, n // 3)))
    df = df.withColumns({"_vm": vol(bars(s.momentum_vol)), "_vs": vol(bars(s.vol[0])), "_vl": vol(bars(s.vol[1]))})
    weight = s.least_weight + (1 - s.least_weight) * sc.sigmoid(sc.clip(s.gamma * F.ln((c("_vs") + sc.EPS) / (c("_vl") + sc.EPS)), -40.0, 40.0))
    df = df.withColumns({"trend_pressure": c("_mom") / (bars(s.momentum) ** 0.5 * (c("_vm") + sc.EPS)), "vol_adaptive": weight * c("_vs") + (1 - weight) * c("_vl")})
    df = rc.local_slope(df, keys, [ts], "_log", "_slope", *s.noises, update_first=True).withColumn("kalman_slope", c("_slope") * hour)
    made = [f"{side}_{x}" for side in ("long", "short") for x in ("spike", "velocity", "acceleration")] + ["trend_pressure", "kalman_slope", "vol_adaptive"]
    return df.select(*names, *made)


@dataclass(frozen=True)
class DominanceSettings:
    """Rows of the quantiles, of the bins' first fit and refits, and of reversals; the defaults are the published ones."""

    rows: int = 365 * 24
    least: int = 24 * 30
    first: int = 24 * 30
    every: int = 24
    reverse_rows: int = 8
    reverse_step: float = 0.2


def dominance(df: DataFrame, keys: Keys, ts: str, long_side: str, short_side: str, s: DominanceSettings = DominanceSettings()) -> DataFrame:
    """The whole chain of two sides' dominance: difference and share, its point-in-time bin, rolling thresholds, the dominating side, slopes, runs and
    entries, hits of ceiling and bottom and the reversals after them, each without repeats within three rows."""
    c, w = F.col, ordered(keys, ts)
    df = df.withColumns({"diff": c(long_side) - c(short_side), "rpn": sc.safe_ratio(long_side, c(long_side) + c(short_side), 0.5)})
    df = ranks.expanding_bins(df, keys, ts, "diff", 9, s.first, s.every, 4, "bin")
    span = {"least": s.least, "rows": s.rows}
    df = ranks.rolling_quantiles(df, keys, ts, "diff", {"thr_pos": 0.8, "thr_neg": 0.2, "thr_pos_base": 0.6, "thr_neg_base": 0.4}, **span)
    for side, name in ((long_side, "long_high"), (short_side, "short_high")):
        df = ranks.rolling_quantiles(df, keys, ts, side, {name: 0.8}, **span)
    up = ((c("bin") <= 3) & (c("diff") <= c("thr_neg"))) | ((c("bin") == 4) & (c("rpn") <= 0.48) & (c("diff") <= c("thr_neg_base")))
    down = ((c("bin") >= 5) & (c("diff") >= c("thr_pos"))) | ((c("bin") == 4) & (c("rpn") >= 0.52) & (c("diff") >= c("thr_pos_base")))
    df = df.withColumn("dominance", F.when(up, 1).when(down, -1).otherwise(0))
    df = df.withColumns({f"beta_{n}": wn.rolling_slope(c("diff"), keys, ts, n) for n in (3, 8, 10, 24)})
    d = c("dominance")
    df = df.withColumns({"_step": F.abs(c("diff") - F.lag("diff").over(w)), "thr_range": c("thr_pos") - c("thr_neg"), "dominance_prev": F.coalesce(F.lag("dominance").over(w), F.lit(0)), "dominance_last": F.coalesce(islands.last_matching(d, d != 0, keys, ts), F.lit(0))})
    df = islands.entry_counter(islands.run_length(df, keys, ts, "dominance", "dominance_duration"), keys, ts, "dominance", "dominance_time")
    beta = F.lag("beta_3").over(w)
    ceiling = (d == 1) & (c("diff") <= c("thr_neg")) & (c(short_side) >= c("short_high")) & (beta < 0) & (c("beta_3") >= 0)
    bottom = (d == -1) & (c("diff") >= c("thr_pos")) & (c(long_side) >= c("long_high")) & (beta > 0) & (c("beta_3") <= 0)
    df = df.withColumns({
        "max_variation": F.max("_step").over(rows(keys, ts, 24)), "dominance_total": F.when(d != 0, c("dominance_duration")).otherwise(0), "dominance_class": F.when(d == 1, "Bull").when(d == -1, "Bear").otherwise("Congestion"),
        "is_keep": ((d != 0) & (d == c("dominance_prev"))).cast("int"), "is_strengthen": ((d != 0) & (d == c("dominance_last"))).cast("int"), "_hit": F.when(ceiling, -1).when(bottom, 1).otherwise(0),
    })
    event = c("_hit") != 0
    df = islands.rows_since(df, keys, ts, event, "_since").withColumns({"_at": islands.last_matching(c("diff"), event, keys, ts), "_kind": islands.last_matching(c("_hit"), event, keys, ts)})
    near = c("_since").between(1, s.reverse_rows)
    back = F.when(near & (c("_kind") == -1) & (c("diff") <= c("_at") - s.reverse_step), 1).when(near & (c("_kind") == 1) & (c("diff") >= c("_at") + s.reverse_step), -1).otherwise(0)
    df = df.withColumn("_back", back)
    df = df.withColumns({"hit_ceiling_bottom": wn.repeat_suppressed(c("_hit"), keys, ts), "reverse_ceiling_bottom": wn.repeat_suppressed(c("_back"), keys, ts)})
    return df.drop("_step", "_hit", "_since", "_at", "_kind", "_back")
