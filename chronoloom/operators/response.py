"""Responses to pressure: events by horizon with calibrated percentiles and labels, curves over horizons, memory, and paths.

Labels and contexts are result values (fixed); each decision is a list of (condition, value), the first that holds counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import DAY, HOUR, Keys, at_least, ordered, rows
from chronoloom.operators import ranks, scans, windows as wn
from chronoloom.operators.aggregates import hierarchical_cdf
from chronoloom.operators.asof import asof_join
from chronoloom.operators.joins import with_thresholds
from chronoloom.operators.recursive import ordered_scan

CORE, WEAK = "directional_core", "weak_directional_context"
PHASES = ("early_strong_entry", "accelerating", "mature", "normal", "neutral")
SEVERITIES = {2: "strong", 1: "mild", 0: "neutral"}


def decide(rules: Sequence[tuple[Column, str | Column]], otherwise: str | Column | None) -> Column:
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def severity_bucket(severity: Column) -> Column:
    return decide([(severity == k, v) for k, v in SEVERITIES.items()], "unknown")


def phase_group(phase: Column) -> Column:
    phase = F.coalesce(phase, F.lit("unknown"))
    return F.when(phase.isin(*PHASES), phase).otherwise("other")


def tercile_regime(df: DataFrame, value: str, train: Column, out: str) -> DataFrame:
    """low, mid or high by the terciles of the training rows; unknown without a value or without training rows."""
    q = df.where(train).agg(F.percentile(value, [1 / 3, 2 / 3]).alias("_q"))
    x, lo, hi = F.col(value), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return with_thresholds(df, q).withColumn(out, decide([(x.isNull() | lo.isNull(), "unknown"), (x <= lo, "low"), (x <= hi, "mid")], "high")).drop("_q")


def base_context(df: DataFrame, keys: Keys, ts: str, returns: Mapping[str, tuple[str, int]], main: str, train: Column, severity: str, phase: str, window: int = 168, least: int = 48) -> DataFrame:
    """Buckets of severity and phase, a matured scale for each horizon's return (name: column, rows until it is known), and the
    regime of the main one."""
    df = df.withColumns({"severity_bucket": severity_bucket(F.col(severity)), "phase_group": phase_group(F.col(phase))})
    for name, (column, lag) in returns.items():
        df = wn.matured_sigma(df, keys, ts, column, lag, window, least, max(5, least // 4), f"sigma_{name}")
    return tercile_regime(df, f"sigma_{main}", train, "vol_regime")


@dataclass(frozen=True)
class Limits:
    """Thresholds of events; the defaults are the published ones."""

    core: tuple[float, float] = (0.65, 0.20)  # reliability, signal to noise
    weak: tuple[float, float] = (0.30, 0.10)
    snr_span: tuple[float, float] = (0.10, 0.45)
    sigma_weight: float = 0.75
    eps: float = 1e-9
    winsor: float = 5.0
    tanh_scale: float = 2.0
    deadzone: tuple[float, float] = (0.15, 0.10)  # of the expected size, of sigma
    amplification: float = 1.25


def response_context(direction: Column, reliability: Column, snr: Column, expected: Column, least: Column | float, s: Limits = Limits()) -> Column:
    """How far an event's response can be read."""
    r, n, b = (F.coalesce(x, F.lit(0.0)) for x in (reliability, snr, expected))
    return decide(
        [
            (F.coalesce(direction, F.lit(0)) == 0, "true_neutral_plie"),
            ((r >= s.core[0]) & (n >= s.core[1]) & (b >= least), CORE),
            ((r >= s.weak[0]) | (n >= s.weak[1]) | (b >= least), WEAK),
        ],
        "low_quality_plie",
    )


def _dead(expected: Column, sigma: Column, s: Limits) -> Column:
    return F.when(expected.isNotNull() & sigma.isNotNull(), F.greatest(s.deadzone[0] * expected, s.deadzone[1] * sigma))


def directional_label(u: Column, amplitude: Column, aligned: Column, expected: Column, sigma: Column, s: Limits = Limits()) -> Column:
    """Name of a directional response by its rank among training responses."""
    return decide(
        [
            (u.isNull(), "unavailable"),
            ((u >= 0.85) & (amplitude > 0), "passive_amplification"),
            ((u >= 0.65) & (u < 0.85), "baseline_transmission"),
            ((u >= 0.35) & (u < 0.65), "normal_response"),
            ((u < 0.15) & (aligned < 0), "reversal_takeover"),
            ((u < 0.35) & (F.abs(aligned) < _dead(expected, sigma, s)), "full_absorption_stall"),
            (u < 0.35, "partial_absorption"),
        ],
        "normal_response",
    )


def weak_label(aligned: Column, ratio: Column, expected: Column, sigma: Column, s: Limits = Limits()) -> Column:
    return decide(
        [
            (aligned.isNull(), "weak_directional_unavailable"),
            (F.abs(aligned) <= _dead(expected, sigma, s), "weak_directional_stall_candidate"),
            (ratio >= s.amplification, "weak_directional_amplification_candidate"),
            (aligned > 0, "weak_directional_transmission_candidate"),
            (aligned < 0, "weak_directional_rejection_candidate"),
        ],
        "weak_directional_uncertain",
    )


def neutral_label(active_z: Column) -> Column:
    return decide([(active_z.isNull(), "unavailable"), (active_z < 0.75, "low_active_move"), (active_z < 1.5, "normal_active_move"), (active_z < 3, "strong_active_move")], "extreme_active_move")


@dataclass(frozen=True)
class Horizon:
    """A horizon and the columns of its return, expected size, effective signed size and scale."""

    name: str
    minutes: int
    ret: str
    expected: str
    effective: str
    sigma: str
    least: float


def response_events(
    base: DataFrame, keep: Sequence[str], ts: str, horizons: Sequence[Horizon], direction: str, reliability: str, train: Column, least_bucket: int = 500,
    levels: Sequence[Sequence[str]] = (("horizon", "severity_bucket", "phase_group", "vol_regime"), ("horizon", "severity_bucket", "vol_regime"), ("horizon", "vol_regime"), ("horizon",), ()),
    neutral_levels: Sequence[Sequence[str]] = (("horizon", "vol_regime"), ("horizon",), ()), s: Limits = Limits(),
) -> DataFrame:
    """One row for each base row and horizon: scores, context, percentiles among training responses, labels; available when matured."""
    c = F.col
    each = F.array(*[
        F.struct(F.lit(h.name).alias("horizon"), F.lit(h.minutes).alias("horizon_minutes"), c(h.ret).cast("double").alias("ret"), c(h.expected).cast("double").alias("expected"), c(h.effective).cast("double").alias("effective"), c(h.sigma).cast("double").alias("sigma"), F.lit(float(h.least)).alias("_least"))
        for h in horizons
    ])
    e = base.select(*keep, c(ts).alias("event_time"), F.coalesce(c(direction), F.lit(0)).alias("direction"), F.coalesce(c(reliability), F.lit(0.0)).alias("reliability"), F.coalesce(train, F.lit(False)).alias("_train"), F.inline(each))
    e = e.withColumns({"available_time": c("event_time") + F.make_dt_interval(mins=c("horizon_minutes")), "snr": c("expected") / (c("sigma") + s.eps), "aligned": c("direction") * c("ret")})
    scale = F.sqrt(c("expected") * c("expected") + s.sigma_weight**2 * c("sigma") * c("sigma") + s.eps)
    low, full = s.snr_span
    residual = c("ret") - c("direction") * c("expected")
    e = e.withColumns({
        "context": response_context(c("direction"), c("reliability"), c("snr"), c("expected"), c("_least"), s), "quality_weight": c("reliability") * sc.clip((c("snr") - low) / (full - low), 0.0, 1.0),
        "transmission": c("aligned") / (c("expected") + s.eps), "z_amp": (c("aligned") - c("expected")) / scale, "z_takeover": -c("aligned") / scale,
        "active_z": F.abs("ret") / (c("sigma") + s.eps), "_residual": sc.clip(residual, -s.winsor * F.abs("sigma"), s.winsor * F.abs("sigma")),
    })
    core = c("context") == CORE
    e = e.withColumns({"_size": F.when(core, c("transmission")).otherwise(c("active_z")), "z_abs": -c("z_amp"), "absorption_raw": 1 - c("transmission"), "active_residual": c("quality_weight") * c("_residual")})
    e = hierarchical_cdf(e, levels, "_size", c("_train"), least_bucket, "_u", ~core, neutral_levels)
    e = e.withColumns({"u": F.when(core, c("_u")), "neutral_u": F.when(~core, c("_u"))})
    neutral = F.when(~core, neutral_label(c("active_z")))
    directional = decide([(core, directional_label(c("u"), c("z_amp"), c("aligned"), c("expected"), c("sigma"), s)), (c("context") == WEAK, weak_label(c("aligned"), c("transmission"), c("expected"), c("sigma"), s))], None)
    market = decide([(c("context") == "true_neutral_plie", F.concat(F.lit("neutral_"), neutral)), (c("context") == "low_quality_plie", F.concat(F.lit("low_quality_"), neutral))], directional)
    e = e.withColumns({
        "absorption_score": 100 * (1 - c("u")), "active_force_aligned": c("quality_weight") * (2 * c("u") - 1), "neutral_active_strength": 100 * c("neutral_u"), "neutral_active_label": neutral,
        "neutral_active_force": F.signum("ret") * F.tanh(c("active_z") / s.tanh_scale) * (1 - sc.clip(c("quality_weight"), 0.0, 1.0)), "directional_label": directional, "market_label": market,
    })
    return e.withColumn("active_force_price", c("direction") * c("active_force_aligned")).drop("_train", "_least", "_size", "_u", "_residual")


def absorption_curve(events: DataFrame, keys: Sequence[str], keep: Sequence[str], horizons: tuple[str, str, str] = ("20m", "30m", "60m")) -> DataFrame:
    """One row per event: its percentiles at three horizons, the curve's label and their conflict; available at the last horizon."""
    c = F.col
    names = [f"u{h.removesuffix('m')}" for h in horizons]
    first = [F.max(F.when(c("horizon") == h, c("u"))).alias(n) for h, n in zip(horizons, names, strict=True)]
    curve = events.groupBy(*keys, "event_time").agg(*first, F.max(F.when(c("horizon") == horizons[1], c("neutral_active_strength"))).alias("neutral_active"), F.max("available_time").alias("available_time"), *[F.first(k, True).alias(k) for k in keep])
    a, b, d = (c(n) for n in names)
    label = decide(
        [
            ((a.isNull() | b.isNull() | d.isNull()) & (c("neutral_active") >= 85), "neutral_active_dominance"),
            (a.isNull() | b.isNull() | d.isNull(), "mixed_or_noise"),
            ((a <= 0.20) & (b <= 0.20) & (d <= 0.20), "persistent_reversal_takeover"),
            ((a >= 0.80) & (b >= 0.80) & (d >= 0.80), "persistent_cascade_transmission"),
            ((a >= 0.75) & (b >= 0.65) & (d >= 0.65), "fast_to_sustained_transmission"),
            ((a <= 0.35) & (d >= 0.65), "delayed_transmission"),
            ((a >= 0.65) & (d <= 0.35), "delayed_absorption"),
            ((a <= 0.25) & (b <= 0.35) & (d <= 0.35), "fast_absorption_or_takeover"),
        ],
        "mixed_or_noise",
    )
    return curve.withColumns({"curve_label": label, "conflict": F.greatest(a, b, d) - F.least(a, b, d)})


def response_memory(base: DataFrame, ts: str, events: DataFrame, curve: DataFrame, keys: Keys, main: str, tie: str, spans: Sequence[int] = (3, 6, 12), persistence: int = 6, takeover: int = 12, half_life: float = 24.0, mode: int = 6, chunk: int = DAY) -> DataFrame:
    """What matured events say at each time of ``base``: last values, averages with and without staleness, persistence of labels, curve.

    Events that mature at one time are taken in the order of ``tie``; the last of them stands. Only the last events before each time of
    ``base`` are put in order by key, the others are summed up in chunks of time (``scans.tails``).
    """
    c = F.col
    order = ["available_time", tie]
    w = ordered(keys, "available_time").orderBy(*order)
    seq = events.where(c("horizon") == main).withColumn("_core", c("context") == CORE)
    seq = seq.withColumns({
        "_core_at": F.when(c("_core"), sc.micros("available_time")), "_quality": F.when(c("_core"), F.coalesce("quality_weight", F.lit(0.0))).otherwise(0.0),
        "_neutral": F.when(c("_core"), 0.0).otherwise(F.coalesce("neutral_active_strength", F.lit(0.0))),
    })
    kept = {"abs_score": "absorption_score", "force_aligned": "active_force_aligned", "force_price": "active_force_price", "neutral_strength": "neutral_active_strength"}
    specs = {f"{n}_ewm_{k}": (v, k, True) for k in spans for n, v in kept.items()} | {f"quality_ewm_{k}": ("_quality", k, False) for k in spans} | {f"neutral_evidence_ewm_{k}": ("_neutral", k, False) for k in spans}
    parts = [scans.Average([value], [n], 2 / (span + 1), ignore) for n, (value, span, ignore) in specs.items()] + [scans.Average(["_core_at"], ["_last_core"], 1.0)]  # of span 1: the last value
    seq = seq.select(*keys, *order, "_core", "market_label", *dict.fromkeys(p.inputs[0] for p in parts))
    seq = scans.tails(seq, keys, order, parts, max(persistence, takeover), base, ts, chunk)
    seq = seq.withColumn("last_core_time", F.timestamp_micros(c("_last_core").cast("long")).cast(seq.schema["available_time"].dataType))
    age = (sc.micros("available_time") - sc.micros("last_core_time")) / HOUR
    seq = seq.withColumns({"core_age_hours": age, "core_freshness": sc.clip(sc.half_life(age, half_life), 0.0, 1.0)})
    f, out = c("core_freshness"), [*specs]
    for k in spans:
        seq = seq.withColumns({f"abs_score_fresh_{k}": 50 + f * (c(f"abs_score_ewm_{k}") - 50)} | {f"{n}_fresh_{k}": f * F.coalesce(f"{n}_ewm_{k}", F.lit(0.0)) for n in ("force_aligned", "force_price")})
        out += [f"abs_score_fresh_{k}", f"force_aligned_fresh_{k}", f"force_price_fresh_{k}"]
    says = lambda pattern: F.coalesce(c("market_label"), F.lit("")).rlike(pattern).cast("double")
    last = lambda n: w.rowsBetween(1 - n, 0)
    shares = {
        "amplification_persistence": F.avg(says("amplification|cascade")).over(last(persistence)), "absorption_persistence": F.avg(says("absorption|stall|rejection|takeover")).over(last(persistence)),
        "takeover_count": F.sum(says("takeover|rejection")).over(last(takeover)), "neutral_strong_count": F.sum(says("strong_active_move|extreme_active_move")).over(last(takeover)),
        "neutral_context_persistence": F.avg((~c("_core")).cast("double")).over(last(takeover)),
    }
    seq = seq.withColumns(shares | {f"{n}_last": c(v) for n, v in (kept | {"market_label": "market_label"}).items()})
    out += [*shares, *(f"{n}_last" for n in kept), "market_label_last", "core_freshness", "core_age_hours", "last_core_time", "latest_available_time"]
    seq = seq.withColumn("latest_available_time", c("available_time"))
    mem = asof_join(base, seq, ts, keys, out, right_on="available_time", tie=tie)
    order = [x for x in order if x in curve.columns]
    curve = scans.tails(curve.select(*keys, *order, "curve_label", "conflict"), keys, order, [], mode, base, ts, chunk)
    curve = curve.withColumn("_order", F.struct(*order))  # curves of one time in the order of ``tie``
    curve = wn.rolling_mode(curve, keys, "_order", "curve_label", mode, "curve_label_mode").withColumns({"curve_label_last": c("curve_label"), "curve_conflict": c("conflict")})
    return asof_join(mem, curve, ts, keys, ["curve_label_last", "curve_label_mode", "curve_conflict"], right_on="available_time", tie=order[1] if len(order) > 1 else None)


@dataclass(frozen=True)
class PathSettings:
    """Windows and thresholds of paths; the defaults are the published ones."""

    windows: Sequence[int] = (6, 12, 24, 48)
    price: Mapping[int, str] = field(default_factory=lambda: {6: "6h", 12: "6h", 24: "24h", 48: "24h"})
    vol_rows: int = 168
    vol_least: int = 48
    sigma_weight: float = 0.75
    eps: float = 1e-9
    core: float = 0.70
    weak: float = 0.55
    mixed: float = 0.35
    mass: tuple[float, float] = (0.30, 0.70)
    active: tuple[float, float, float] = (0.75, 1.50, 3.00)  # normal, strong, extreme
    ratios: tuple[float, float, float, float, float] = (1.25, 0.65, 0.15, -0.15, -0.65)
    cascade: float = 0.35
    quiet: float = 0.60
    chop: float = 0.55
    bound: float = 20.0
    chop_directionality: float = 0.40
    impact: tuple[float, float] = (8.0, 8.0)  # net and total expected size over the window
    share: float = 0.5  # of rows with a direction
    reliability: tuple[float, float] = (0.30, 0.55)  # weak, core
    snr: tuple[float, float] = (0.10, 0.25)


PATH_CORE, PATH_WEAK, PATH_MIXED, PATH_NEUTRAL = "path_directional_core", "path_directional_weak", "path_mixed_pressure", "path_neutral_pressure"


def path_absorption(df: DataFrame, keys: Keys, ts: str, price: str, direction: str, reliability: str, intensity: str, size: str, effective: str, train: Column, s: PathSettings = PathSettings()) -> DataFrame:
    """One row for each row and window: pressure, context, scores, label and quality of the path over the window.

    ``df`` has the price context columns realized_vol, trend_strength, trend_consistency, trend_direction, range_compression,
    jump_proxy, price_missing_ratio, price_gap_flag and price_outlier_flag with the suffixes of ``s.price``.
    """
    c, w = F.col, ordered(keys, ts)
    zero = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    d = df.withColumns({"_d": zero(direction), "_rel": zero(reliability), "_b": zero(size), "_eff": zero(effective), "_unit": zero(direction) * zero(reliability) * zero(intensity), "_train": F.coalesce(train, F.lit(False))})
    context = ("realized_vol", "trend_strength", "range_compression", "jump_proxy")
    for n in s.windows:
        frame = rows(keys, ts, n)
        full = lambda x, n=n, frame=frame: at_least(x, c("_unit"), frame, n)
        d = d.withColumns({
            f"_ret{n}": sc.log_return_bps(c(price), F.lag(price, n).over(w)), f"_mass{n}": full(F.sum(F.abs("_unit")).over(frame)), f"_net{n}": full(F.sum("_unit").over(frame)), f"_obs{n}": F.count("_unit").over(frame),
            f"_raw{n}": full(F.sum(c("_d") * c("_b")).over(frame)), f"_tot{n}": full(F.sum(F.abs(c("_d") * c("_b"))).over(frame)), f"_base{n}": full(F.sum("_eff").over(frame)), f"_share{n}": full(F.avg((F.abs("_d") > 0).cast("double")).over(frame)), f"_rm{n}": full(F.avg("_rel").over(frame)),
        })
        d = d.withColumn("_before", F.lag(f"_ret{n}").over(w))
        d = ranks.nested_deviation(d, keys, ts, "_before", s.vol_rows, s.vol_least, "_med", f"_mad{n}").withColumn(f"_sigma{n}", F.when(c(f"_mad{n}") > 0, 1.4826 * c(f"_mad{n}"))).drop("_before", "_med", f"_mad{n}")
    suffixes = sorted(set(s.price.values()))
    fit = [F.percentile(F.when(c("_train"), c(f"_mass{n}")), list(s.mass)).alias(f"_qm{n}") for n in s.windows]
    fit += [F.percentile(F.when(c("_train"), c(f"{x}_{h}")), [0.30, 0.70]).alias(f"_q_{x}_{h}") for x in context for h in suffixes]
    d = with_thresholds(d, d.agg(*fit))
    parts = []
    for n in s.windows:
        h = s.price[n]
        own = {k: c(f"_{v}{n}") for k, v in {"ret": "ret", "mass": "mass", "net": "net", "obs": "obs", "raw": "raw", "total": "tot", "baseline": "base", "share": "share", "rel": "rm", "sigma": "sigma"}.items()}
        cut = {"mass_low": F.get(f"_qm{n}", F.lit(0)), "mass_high": F.get(f"_qm{n}", F.lit(1))} | {f"{x}_{k}": F.get(f"_q_{x}_{h}", F.lit(j)) for x in context for j, k in enumerate(("low", "high"))}
        held = {x: c(f"{x}_{h}") for x in (*context, "trend_consistency", "trend_direction", "price_missing_ratio", "price_gap_flag", "price_outlier_flag")}
        parts.append(F.struct(F.lit(n).alias("window_hours"), *[v.cast("double").alias(k) for k, v in (own | cut | held).items()]))
    p = d.select(*keys, c(ts).alias("time"), "_d", F.inline(F.array(*parts)))
    return _scored(p, keys, s)


def _scored(p: DataFrame, keys: Keys, s: PathSettings) -> DataFrame:
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    n = c("window_hours")
    p = p.withColumns({"directionality": F.abs("net") / (c("mass") + s.eps), "dominant": F.coalesce(F.signum("net"), F.lit(0.0)), "missing": sc.clip(1 - c("obs") / n, 0.0, 1.0)})
    mature = c("ret").isNotNull() & c("mass").isNotNull() & (c("obs") >= 0.8 * n)
    busy = mature & (c("total") >= s.impact[1]) & (c("share") >= s.share)
    high, some, net = busy & (c("mass") >= c("mass_high")), busy & (c("mass") > c("mass_low")), F.abs("raw") >= s.impact[0]
    sure = lambda k: (c("rel") >= s.reliability[k]) & (c("mass") / (c("sigma") + s.eps) >= s.snr[k])
    p = p.withColumn("context", decide(
        [(yes(high & net & sure(1) & (c("directionality") >= s.core)), PATH_CORE), (yes(some & net & sure(0) & (c("directionality") >= s.weak)), PATH_WEAK), (yes(some | (high & (c("directionality") < s.mixed))), PATH_MIXED)], PATH_NEUTRAL))
    directed = c("context").isin(PATH_CORE, PATH_WEAK)
    p = p.withColumn("aligned", F.when(directed, c("dominant")).otherwise(0.0) * c("ret"))
    scale = F.sqrt(c("baseline") * c("baseline") + s.sigma_weight**2 * c("sigma") * c("sigma") + s.eps)
    normal, strong, extreme = s.active
    flag = lambda x, k, up: yes((c(x) >= c(f"{x}_{k}")) if up else (c(x) <= c(f"{x}_{k}")))
    p = p.withColumns({
        "transmission_ratio": F.when(F.abs("baseline") > s.eps, c("aligned") / (F.abs("baseline") + s.eps)).otherwise(c("aligned") / (c("mass") + s.eps)), "transmission": c("aligned") / scale, "divergence": -c("aligned") / scale,
        "active_z": F.abs("ret") / (c("sigma") + s.eps), "vol_low": flag("realized_vol", "low", False), "vol_high": flag("realized_vol", "high", True), "trend_low": flag("trend_strength", "low", False),
        "trend_high": flag("trend_strength", "high", True), "range_high": flag("range_compression", "high", True), "jump_high": flag("jump_proxy", "high", True),
    })
    one = lambda x: c(x).cast("double")
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    unit = lambda x: sc.clip(x, 0.0, 1.0)
    boost = lambda x: F.when(c(x).isNotNull(), F.greatest(F.lit(0.0), F.tanh(sc.clip(c(x), -s.bound, s.bound))))
    p = p.withColumn("trend_against", c("trend_high") & (zero("trend_direction") * c("dominant") < 0))
    p = p.withColumns({
        "cascade_score": unit(boost("transmission") * (0.60 + 0.40 * (one("vol_high") + one("jump_high")) / 2)), "rejection_score": unit(boost("divergence") * (0.60 + 0.40 * one("trend_against"))),
        "absorption_score": 100 * sc.sigmoid(c("divergence"), s.bound), "active_dominance": F.tanh(sc.clip((c("active_z") - normal) / (extreme - normal), 0.0, 2.0)),
        "quiet_score": unit(0.35 * one("vol_low") + 0.30 * one("trend_low") + 0.25 * one("range_high") + 0.10 * (1 - one("jump_high"))),
        "chop_score": unit(0.35 * one("trend_low") + 0.25 * (1 - unit(zero("trend_consistency"))) + 0.25 * one("range_high") + 0.15 * yes(c("directionality") < s.chop_directionality).cast("double")),
    })
    p = p.withColumn("label", path_label(s))
    bad = 0.55 * F.coalesce("missing", F.lit(1.0)) + 0.25 * unit(zero("price_gap_flag")) + 0.20 * unit(zero("price_missing_ratio")) + 0.10 * unit(zero("price_outlier_flag"))
    p = p.withColumn("data_quality", F.when(mature, unit(1 - bad)).otherwise(0.0))
    larger = lambda a, b: F.when(c(a).isNotNull() & c(b).isNotNull(), F.greatest(a, b))
    margin = decide([(directed, larger("cascade_score", "rejection_score")), (c("context") == PATH_NEUTRAL, larger("active_dominance", "quiet_score"))], larger("active_dominance", "chop_score"))
    clarity = (
        0.35 * F.when(directed, F.coalesce(unit(c("directionality")), F.lit(0.0))).otherwise(0.0) + 0.30 * margin + 0.20 * F.when(c("context") == PATH_NEUTRAL, c("quiet_score")).otherwise(0.0)
        + 0.20 * F.when(c("context") == PATH_MIXED, c("chop_score")).otherwise(0.0) + 0.15 * c("data_quality")
    )
    share = lambda x: F.when(c(f"{x}_high").isNull(), 0.0).otherwise(unit(c(x) / (c(f"{x}_high") + s.eps)))
    activity = 0.30 * F.coalesce(unit(c("mass") / (c("mass_high") + s.eps)), F.lit(0.0)) + 0.25 * share("realized_vol") + 0.25 * share("trend_strength") + 0.20 * share("jump_proxy")
    p = p.withColumns({"signal_clarity": unit(clarity), "activity_level": F.coalesce(unit(activity), F.lit(0.0)), "active_direction": F.coalesce(F.signum("ret"), F.lit(0.0))})
    p = p.withColumns({"quality": unit(c("data_quality") * c("signal_clarity")), "active_dominance_price": c("active_direction") * c("active_dominance")})
    force = c("quality") * F.tanh(sc.clip(c("transmission"), -20.0, 20.0))
    name = decide([(c("context") == PATH_NEUTRAL, "neutral_pressure"), (c("context") == PATH_MIXED, "mixed_pressure"), (c("dominant") > 0, "upward_pressure"), (c("dominant") < 0, "downward_pressure")], "neutral_pressure")
    p = p.withColumns({"force_aligned": force, "force_price": c("dominant") * force, "pressure_name": name, "snr": c("mass") / (c("sigma") + s.eps)})
    return p.select(
        *keys, "time", "window_hours", "context", "label", "pressure_name", "mass", "net", "directionality", "dominant", "obs", "missing", c("ret").alias("path_return"), "baseline", "aligned", "transmission_ratio", "transmission", "divergence",
        "active_z", "active_dominance", "active_dominance_price", "absorption_score", "cascade_score", "rejection_score", "quiet_score", "chop_score", "data_quality", "signal_clarity", "activity_level", "quality", "force_aligned", "force_price", "snr", "share", c("rel").alias("reliability_mean"),
    )


def path_label(s: PathSettings) -> Column:
    """The label of a path by its context, from the columns of its scores."""
    c = F.col
    way = F.when(c("ret") > 0, "up").otherwise("down")
    normal, strong, _ = s.active
    tr, (amp, base, part, stall, negative) = c("transmission_ratio"), s.ratios
    directional = decide(
        [
            (tr.isNull(), "path_unavailable"), ((tr >= amp) & (c("cascade_score") >= s.cascade), "path_cascade_transmission"), (tr >= base, "path_baseline_transmission"), (tr >= part, "path_partial_absorption"),
            (tr >= stall, "path_full_absorption_stall"), ((tr <= negative) & ((c("divergence") > 0.75) | c("trend_against")), "path_reversal_takeover"),
        ],
        "path_pressure_rejection",
    )
    unknown, still = c("ret").isNull() | c("active_z").isNull(), (F.abs("ret") < 1e-12) | (c("active_z") < normal)
    loud = (c("active_z") >= strong) & c("trend_high")
    neutral = decide([(unknown, "path_unavailable"), ((c("quiet_score") >= s.quiet) | still, "path_quiet_no_pressure"), (loud, F.concat(F.lit("path_active_dominance_"), way))], F.concat(F.lit("path_normal_active_dominance_"), way))
    mixed = decide([(unknown, "path_unavailable"), ((c("chop_score") >= s.chop) | still, "path_mixed_pressure_chop"), (loud, F.concat(F.lit("path_mixed_active_breakout_"), way))], F.concat(F.lit("path_normal_mixed_active_breakout_"), way))
    return decide([(c("context").isin(PATH_CORE, PATH_WEAK), directional), (c("context") == PATH_MIXED, mixed)], neutral)


WIDE = ("context", "label", "mass", "net", "directionality", "dominant", "aligned", "baseline", "absorption_score", "rejection_score", "active_dominance", "transmission_ratio", "cascade_score", "data_quality", "signal_clarity", "activity_level")


def multiscale(paths: DataFrame, keys: Keys, windows: Sequence[int] = (6, 12, 24, 48), columns: Sequence[str] = WIDE) -> DataFrame:
    """One row for each time, with the columns of every window side by side, by one aggregate."""
    picks = [F.max(F.when(F.col("window_hours") == n, F.col(x))).alias(f"{x}_{n}h") for x in columns for n in windows]
    return paths.groupBy(*keys, "time").agg(*picks)


STATES = ("ST", "VT", "RC", "RHA", "HPEM", "AMB")


def state_evidence(wide: DataFrame, windows: Sequence[int] = (6, 12, 24, 48)) -> DataFrame:
    """Evidence for six states from the labels, contexts and qualities of all windows; the strongest state and its margin."""
    c, unit = F.col, lambda x: sc.clip(x, 0.0, 1.0)
    says = lambda what, pattern, wins: [F.coalesce(c(f"{what}_{n}h"), F.lit("")).rlike(pattern).cast("double") for n in wins]
    share = lambda what, pattern, wins: sum(says(what, pattern, wins), F.lit(0.0)) / len(wins)
    any_of = lambda what, pattern, wins: F.greatest(*says(what, pattern, wins))

    def mean(x: str) -> Column:
        known = [c(f"{x}_{n}h") for n in windows]
        return sc.divide(sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0)), sum((F.when(k.isNotNull(), 1).otherwise(0) for k in known), F.lit(0)))

    data, clarity, activity = (F.coalesce(mean(x), F.lit(v)) for x, v in (("data_quality", 0.0), ("signal_clarity", 0.0), ("activity_level", 1.0)))
    cascade, reject, active, quiet = (any_of("label", p, windows) > 0 for p in ("cascade", "rejection|takeover", "active_dominance|mixed_active_breakout", "quiet_no_pressure"))
    w = wide.withColumns({
        "e_rc_quiet_pressure": share("label", "path_quiet_no_pressure", (6, 12)), "e_rc_good_data_quality": unit(data), "e_rc_low_vol": unit(1 - activity),
        "e_rha_reversal_takeover": any_of("label", "path_reversal_takeover", (12, 24, 48)), "e_rha_pressure_rejection": any_of("label", "path_pressure_rejection", (12, 24)), "e_rha_full_absorption_stall": any_of("label", "path_full_absorption_stall", (12, 24)),
        "e_amb_cross_window_conflict": ((cascade & reject) | (active & reject) | (cascade & quiet)).cast("double"), "e_amb_data_quality_bad": unit(1 - data),
        "e_vt_active_dominance": any_of("label", "active_dominance", (6, 12, 24)), "e_vt_trend_breakout": any_of("label", "mixed_active_breakout", (6, 12, 24)), "e_vt_neutral_plie": any_of("context", "neutral_pressure|mixed_pressure", (6, 12, 24)),
        "e_hpem_cascade_transmission": any_of("label", "path_cascade_transmission", (6, 12, 24)), "e_hpem_jump": unit(F.coalesce(F.greatest(*[c(f"cascade_score_{n}h") for n in (6, 12, 24)]), F.lit(0.0))), "e_hpem_directional_plie": share("context", "path_directional", (6, 12, 24)),
        "e_st_partial_absorption": share("label", "path_partial_absorption|path_baseline_transmission", (6, 12, 24)),
    })
    w = w.withColumns({
        "e_rc_range_compression": unit(F.coalesce("signal_clarity_6h", F.lit(0.0))) * c("e_rc_quiet_pressure"), "e_rc_low_trend": c("e_rc_low_vol"), "e_amb_signal_conflict": unit(0.6 * (1 - clarity) + 0.4 * c("e_amb_cross_window_conflict")),
        "e_st_orderly_trend": unit(1 - c("e_hpem_jump")) * c("e_st_partial_absorption"),
    })
    total = lambda **weights: unit(sum((v * c(f"e_{k}") for k, v in weights.items()), F.lit(0.0)))
    w = w.withColumns({
        "score_rc": total(rc_quiet_pressure=0.25, rc_low_vol=0.20, rc_range_compression=0.20, rc_low_trend=0.15, rc_good_data_quality=0.20), "score_rha": total(rha_reversal_takeover=0.45, rha_pressure_rejection=0.35, rha_full_absorption_stall=0.20),
        "score_vt": total(vt_active_dominance=0.45, vt_trend_breakout=0.45, vt_neutral_plie=0.10), "score_hpem": total(hpem_cascade_transmission=0.40, hpem_jump=0.30, hpem_directional_plie=0.30), "score_st": total(st_partial_absorption=0.55, st_orderly_trend=0.45),
        "score_amb": total(amb_signal_conflict=0.30, amb_data_quality_bad=0.35, amb_cross_window_conflict=0.20),
    })
    scores = [c(f"score_{x.lower()}") for x in STATES]
    w = w.withColumn("e_amb_label_margin_low", 1 - unit(sc.row_margin(*scores)))
    w = w.withColumn("score_amb", total(amb_signal_conflict=0.25, amb_data_quality_bad=0.30, amb_cross_window_conflict=0.20, amb_label_margin_low=0.15))
    return w.withColumns({"state_label": sc.row_argmax(list(STATES), scores), "state_margin": sc.row_margin(*scores)})
