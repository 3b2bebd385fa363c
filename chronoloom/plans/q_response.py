"""Queries: responses by event and horizon, curves, memory, paths and state evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import HOUR  # noqa: F401
from chronoloom.operators import response as rs
from chronoloom.plans.registry import FLOWS, bars, flows, query, r, rounded, table

CUT = "2024-01-20"
HORIZONS = ((20, 2.0), (30, 2.5), (60, 3.0))
PHASE_LIST = ["early_strong_entry", "accelerating", "mature", "normal", "neutral", "fading"]


def _base(spark, sf_dir):
    c = F.col
    e = table(spark, sf_dir, "events")
    e = e.withColumns({
        "d": F.when(c("event_type") == "click", 1).when(c("event_type") == "view", -1).otherwise(0), "r": (c("event_id") % 100) / 100.0, "severity": c("event_id") % 4,
        "phase": F.get(F.array(*map(F.lit, PHASE_LIST)), (c("event_id") % 6).cast("int")), "sigma": (10 + c("event_id") % 7).cast("double"), "train": c("ts") < F.lit(CUT).cast("timestamp_ntz"),
    })
    for h, _ in HORIZONS:
        e = e.withColumns({f"ret{h}": (c("value") - 50) * (1 + ((c("event_id") * h) % 11) / 10.0), f"exp{h}": c("value") / 20 + (c("event_id") % h) / 20.0})
        e = e.withColumn(f"eff{h}", c("d") * c(f"exp{h}") * c("r"))
    e = e.withColumns({"severity_bucket": rs.severity_bucket(c("severity")), "phase_group": rs.phase_group(c("phase"))})
    return rs.tercile_regime(e, "sigma", c("train"), "vol_regime")


def _events(spark, sf_dir):
    horizons = [rs.Horizon(f"{h}m", h, f"ret{h}", f"exp{h}", f"eff{h}", "sigma", least) for h, least in HORIZONS]
    return rs.response_events(_base(spark, sf_dir), ["event_id", "event_type", "severity_bucket", "phase_group", "vol_regime"], "ts", horizons, "d", "r", F.col("train"), 60)


def _level(columns: str, value: str, name: str) -> str:
    part = f"(PARTITION BY {columns + ', ' if columns else ''}{value} IS NULL"
    return f"CASE WHEN {value} IS NOT NULL THEN sum(CASE WHEN train THEN 1 ELSE 0 END) OVER {part} ORDER BY {value}) / nullif(sum(CASE WHEN train THEN 1 ELSE 0 END) OVER {part}), 0) END AS {name}, CASE WHEN {value} IS NOT NULL THEN sum(CASE WHEN train THEN 1 ELSE 0 END) OVER {part}) END AS n{name}"


def _picked(names: list[str], least: int) -> str:
    return "coalesce(" + ", ".join([*(f"CASE WHEN n{n} >= {least} THEN {n} END" for n in names[:-1]), names[-1]]) + ")"


LEVELS = ["horizon, sev, ph, vol", "horizon, sev, vol", "horizon, vol", "horizon", ""]
EV = f"""ev AS (SELECT event_id, event_type, ts, value, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS d, (event_id % 100) / 100.0::DOUBLE AS r, CASE event_id % 4 WHEN 2 THEN 'strong' WHEN 1 THEN 'mild' WHEN 0 THEN 'neutral' ELSE 'unknown' END AS sev,
    CASE WHEN event_id % 6 = 5 THEN 'other' ELSE {PHASE_LIST}[(event_id % 6 + 1)::INT] END AS ph, (10 + event_id % 7)::DOUBLE AS sigma, ts < TIMESTAMP '{CUT}' AS train FROM events),
  tq AS (SELECT quantile_cont(sigma, [1/3, 2/3]) AS q FROM ev WHERE train), vr AS (SELECT ev.*, CASE WHEN q IS NULL THEN 'unknown' WHEN sigma <= q[1] THEN 'low' WHEN sigma <= q[2] THEN 'mid' ELSE 'high' END AS vol FROM ev CROSS JOIN tq),
  x AS ({" UNION ALL ".join(f"SELECT *, '{h}m' AS horizon, {h} AS hm, {least} AS least_b, (value - 50) * (1 + ((event_id * {h}) % 11) / 10.0::DOUBLE) AS ret, value / 20 + (event_id % {h}) / 20.0::DOUBLE AS b FROM vr" for h, least in HORIZONS)}),
  y AS (SELECT *, b / (sigma + 1e-9) AS snr, d * ret AS al FROM x),
  c AS (SELECT *, CASE WHEN d = 0 THEN 'true_neutral_plie' WHEN r >= 0.65 AND snr >= 0.2 AND b >= least_b THEN 'directional_core' WHEN r >= 0.3 OR snr >= 0.1 OR b >= least_b THEN 'weak_directional_context' ELSE 'low_quality_plie' END AS context,
     al / (b + 1e-9) AS tr, (al - b) / sqrt(b * b + 0.5625 * sigma * sigma + 1e-9) AS z_amp, r * least(greatest((snr - 0.1) / 0.35, 0), 1) AS quality_weight, abs(ret) / (sigma + 1e-9) AS active_z, greatest(0.15 * b, 0.1 * sigma) AS dead FROM y),
  v AS (SELECT *, CASE WHEN context = 'directional_core' THEN tr END AS cv, CASE WHEN context <> 'directional_core' THEN active_z END AS nv FROM c),
  l AS (SELECT *, {", ".join(_level(k, "cv", f"u{i}") for i, k in enumerate(LEVELS))}, {", ".join(_level(k, "nv", f"w{i}") for i, k in enumerate(["horizon, vol", "horizon", ""]))} FROM v),
  p AS (SELECT *, {_picked([f"u{i}" for i in range(5)], 60)} AS u, {_picked([f"w{i}" for i in range(3)], 60)} AS neutral_u, CASE WHEN active_z < 0.75 THEN 'low_active_move' WHEN active_z < 1.5 THEN 'normal_active_move' WHEN active_z < 3 THEN 'strong_active_move' ELSE 'extreme_active_move' END AS nl FROM l),
  e AS (SELECT *, CASE context WHEN 'directional_core' THEN CASE WHEN u IS NULL THEN 'unavailable' WHEN u >= 0.85 AND z_amp > 0 THEN 'passive_amplification' WHEN u >= 0.65 AND u < 0.85 THEN 'baseline_transmission' WHEN u >= 0.35 AND u < 0.65 THEN 'normal_response'
       WHEN u < 0.15 AND al < 0 THEN 'reversal_takeover' WHEN u < 0.35 AND abs(al) < dead THEN 'full_absorption_stall' WHEN u < 0.35 THEN 'partial_absorption' ELSE 'normal_response' END
     WHEN 'weak_directional_context' THEN 'weak_directional_' || CASE WHEN al IS NULL THEN 'unavailable' WHEN abs(al) <= dead THEN 'stall_candidate' WHEN tr >= 1.25 THEN 'amplification_candidate' WHEN al > 0 THEN 'transmission_candidate' WHEN al < 0 THEN 'rejection_candidate' ELSE 'uncertain' END END AS directional_label FROM p)"""


@query(f"""WITH {EV} SELECT event_id, horizon, context, {r("u", "neutral_u", digits=10)}, {r("z_amp", "quality_weight", "active_z")}, directional_label, CASE context WHEN 'true_neutral_plie' THEN 'neutral_' || nl WHEN 'low_quality_plie' THEN 'low_quality_' || nl ELSE directional_label END AS market_label,
  round(d * quality_weight * (2 * u - 1), 6) + 0.0 AS active_force_price, round(sign(ret) * tanh(active_z / 2) * (1 - least(greatest(quality_weight, 0), 1)), 6) + 0.0 AS neutral_active_force, ts + INTERVAL 1 MINUTE * hm AS available_time FROM e""")
def absorption_events(spark, sf_dir):
    """Responses of every event over three horizons, ranked among training responses of their bucket, with labels."""
    e = _events(spark, sf_dir)
    exact = [(F.round(c, 10) + F.lit(0.0)).alias(c) for c in ("u", "neutral_u")]
    return e.select("event_id", "horizon", "context", *exact, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("z_amp", "quality_weight", "active_z", "active_force_price", "neutral_active_force")], "directional_label", "market_label", "available_time")


@query(f"""WITH {EV}, g AS (SELECT event_id, max(u) FILTER (horizon = '20m') AS u20, max(u) FILTER (horizon = '30m') AS u30, max(u) FILTER (horizon = '60m') AS u60, max(100 * neutral_u) FILTER (horizon = '30m') AS na FROM e GROUP BY 1)
  SELECT event_id, round(CASE WHEN greatest(u20, u30, u60) IS NOT NULL THEN greatest(u20, u30, u60) - least(u20, u30, u60) END, 10) + 0.0 AS conflict, CASE WHEN u20 IS NULL OR u30 IS NULL OR u60 IS NULL THEN CASE WHEN na >= 85 THEN 'neutral_active_dominance' ELSE 'mixed_or_noise' END
    WHEN u20 <= 0.2 AND u30 <= 0.2 AND u60 <= 0.2 THEN 'persistent_reversal_takeover' WHEN u20 >= 0.8 AND u30 >= 0.8 AND u60 >= 0.8 THEN 'persistent_cascade_transmission' WHEN u20 >= 0.75 AND u30 >= 0.65 AND u60 >= 0.65 THEN 'fast_to_sustained_transmission'
    WHEN u20 <= 0.35 AND u60 >= 0.65 THEN 'delayed_transmission' WHEN u20 >= 0.65 AND u60 <= 0.35 THEN 'delayed_absorption' WHEN u20 <= 0.25 AND u30 <= 0.35 AND u60 <= 0.35 THEN 'fast_absorption_or_takeover' ELSE 'mixed_or_noise' END AS curve_label FROM g""")
def absorption_curve(spark, sf_dir):
    c = rs.absorption_curve(_events(spark, sf_dir), ["event_id"], [])
    return c.select("event_id", (F.round("conflict", 10) + F.lit(0.0)).alias("conflict"), "curve_label")


@query()
def absorption_memory(spark, sf_dir):
    """Memory of matured responses at every bar; a test holds it against a row-by-row restatement."""
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "k")
    return rounded(rs.response_memory(bars(spark, sf_dir).select("k", "t"), "t", e, rs.absorption_curve(e, ["k", "event_id"], []), ["k"], "30m", "event_id"))


FX = "(extract(hour FROM t) % {n})"


def _paths(spark, sf_dir):
    c, hour = F.col, F.hour("t")
    f = flows(spark, sf_dir)
    total, lean = c("fl") + c("fs"), c("fl") - c("fs")
    f = f.withColumns({"d": F.when(F.abs(lean) < 0.1 * total, 0.0).otherwise(F.signum(lean)), "r": F.abs(lean) / (total + 1e-9), "i": F.log1p(total), "b": total / 50, "train": c("t") < F.lit(CUT).cast("timestamp_ntz")})
    f = f.withColumn("eff", c("d") * c("b") * c("r"))
    for h, vol, trend in (("6h", total, c("r")), ("24h", c("fl") + 2 * c("fs"), 1 - c("r"))):
        f = f.withColumns({
            f"realized_vol_{h}": vol, f"trend_strength_{h}": trend, f"trend_consistency_{h}": c("r"), f"trend_direction_{h}": -c("d"), f"range_compression_{h}": (hour % 10) / 10.0, f"jump_proxy_{h}": (hour % 7) / 7.0,
            f"price_missing_ratio_{h}": (hour % 5) / 20.0, f"price_gap_flag_{h}": F.when(hour % 6 == 0, 1.0).otherwise(0.0), f"price_outlier_flag_{h}": F.when(hour % 9 == 0, 1.0).otherwise(0.0),
        })
    return rs.path_absorption(f, ["k"], "t", "price", "d", "r", "i", "b", "eff", c("train"))


def _path_sql() -> str:
    pre = f"""{FLOWS}, b0 AS (SELECT t, k, price, fl, fs, CASE WHEN abs(fl - fs) < 0.1 * (fl + fs) THEN 0.0 ELSE sign(fl - fs) END::DOUBLE AS d, abs(fl - fs) / (fl + fs + 1e-9) AS r, ln(1 + fl + fs) AS i, (fl + fs) / 50 AS b, t < TIMESTAMP '{CUT}' AS train, extract(hour FROM t) AS hr FROM flows),
  b AS (SELECT *, d * r * i AS unit, d * b * r AS eff, (hr % 10) / 10.0::DOUBLE AS rng, (hr % 7) / 7.0::DOUBLE AS jmp, (hr % 5) / 20.0::DOUBLE AS miss, (hr % 6 = 0)::INT AS gap, (hr % 9 = 0)::INT AS outl FROM b0)"""
    parts = []
    for n, vol, trend in ((6, "fl + fs", "r"), (12, "fl + fs", "r"), (24, "fl + 2 * fs", "1 - r"), (48, "fl + 2 * fs", "1 - r")):
        w = f"(ORDER BY t ROWS {n - 1} PRECEDING)"
        pre += f""",
  a{n} AS (SELECT *, {vol} AS rv, {trend} AS trd, CASE WHEN price > 0 AND lag(price, {n}) OVER (ORDER BY t) > 0 THEN 1e4 * ln(price / lag(price, {n}) OVER (ORDER BY t)) END AS ret, count(*) OVER {w} AS obs, CASE WHEN count(*) OVER {w} >= {n} THEN sum(abs(unit)) OVER {w} END AS mass,
     CASE WHEN count(*) OVER {w} >= {n} THEN sum(unit) OVER {w} END AS net, CASE WHEN count(*) OVER {w} >= {n} THEN sum(eff) OVER {w} END AS base,
     CASE WHEN count(*) OVER {w} >= {n} THEN sum(d * b) OVER {w} END AS raw, sum(abs(d * b)) OVER {w} AS tot, avg((d <> 0)::INT) OVER {w} AS shr, avg(r) OVER {w} AS rm FROM b),
  m{n} AS (SELECT *, CASE WHEN count(pr) OVER v >= 48 THEN quantile_cont(pr, 0.5) OVER v END AS med FROM (SELECT *, lag(ret) OVER (ORDER BY t) AS pr FROM a{n}) WINDOW v AS (ORDER BY t ROWS 167 PRECEDING)),
  s{n} AS (SELECT *, CASE WHEN count(dv) OVER v >= 48 THEN nullif(1.4826 * quantile_cont(dv, 0.5) OVER v, 0) END AS sg FROM (SELECT *, abs(pr - med) AS dv FROM m{n}) WINDOW v AS (ORDER BY t ROWS 167 PRECEDING)),
  q{n} AS (SELECT {', '.join(f'quantile_cont({x}, 0.3) FILTER (train) AS {y}_lo, quantile_cont({x}, 0.7) FILTER (train) AS {y}_hi' for x, y in (('mass', 'qm'), ('rv', 'qv'), ('trd', 'qt'), ('rng', 'qr'), ('jmp', 'qj')))} FROM s{n})"""
        parts.append(f"SELECT {n} AS n, s.*, q.* FROM s{n} s CROSS JOIN q{n} q")
    return f"""{pre},
  u AS ({' UNION ALL '.join(parts)}),
  g AS (SELECT *, abs(net) / (mass + 1e-9) AS dirn, coalesce(sign(net), 0) AS dom, least(greatest(1 - obs / n, 0), 1) AS missing, coalesce(ret IS NOT NULL AND mass IS NOT NULL AND obs >= 0.8 * n, false) AS mature FROM u),
  h AS (SELECT *, CASE WHEN mature AND tot >= 8 AND shr >= 0.5 AND abs(raw) >= 8 AND rm >= 0.55 AND mass / (sg + 1e-9) >= 0.25 AND mass >= qm_hi AND dirn >= 0.7 THEN 'path_directional_core' WHEN mature AND tot >= 8 AND shr >= 0.5 AND abs(raw) >= 8 AND rm >= 0.3 AND mass / (sg + 1e-9) >= 0.1 AND mass > qm_lo AND dirn >= 0.55 THEN 'path_directional_weak'
     WHEN mature AND tot >= 8 AND shr >= 0.5 AND (mass > qm_lo OR mass >= qm_hi AND dirn < 0.35) THEN 'path_mixed_pressure' ELSE 'path_neutral_pressure' END AS context FROM g),
  i AS (SELECT *, context IN ('path_directional_core', 'path_directional_weak') AS directed, CASE WHEN context IN ('path_directional_core', 'path_directional_weak') THEN dom ELSE 0 END * ret AS al, sqrt(base * base + 0.5625 * sg * sg + 1e-9) AS scale, abs(ret) / (sg + 1e-9) AS az,
     coalesce(rv <= qv_lo, false)::INT AS vlow, coalesce(rv >= qv_hi, false)::INT AS vhigh, coalesce(trd <= qt_lo, false)::INT AS tlow, coalesce(trd >= qt_hi, false)::INT AS thigh, coalesce(rng >= qr_hi, false)::INT AS rhigh, coalesce(jmp >= qj_hi, false)::INT AS jhigh FROM h),
  j AS (SELECT *, CASE WHEN abs(base) > 1e-9 THEN al / (abs(base) + 1e-9) ELSE al / (mass + 1e-9) END AS tr, al / scale AS ts, -al / scale AS dv2, (thigh = 1 AND -d * dom < 0)::INT AS against FROM i),
  l AS (SELECT *, CASE WHEN ts IS NOT NULL THEN greatest(0, tanh(least(greatest(ts, -20), 20))) * (0.6 + 0.2 * (vhigh + jhigh)) END AS cascade, CASE WHEN ts IS NOT NULL THEN greatest(0, tanh(least(greatest(-ts, -20), 20))) * (0.6 + 0.4 * against) END AS reject,
     CASE WHEN az IS NOT NULL THEN tanh(least(greatest((az - 0.75) / 2.25, 0), 2)) END AS act, 0.35 * vlow + 0.3 * tlow + 0.25 * rhigh + 0.1 * (1 - jhigh) AS quiet, least(0.35 * tlow + 0.25 * (1 - r) + 0.25 * rhigh + 0.15 * coalesce(dirn < 0.4, false)::INT, 1) AS chop FROM j),
  o AS (SELECT *, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS way, CASE WHEN mature THEN least(greatest(1 - (0.55 * missing + 0.25 * gap + 0.2 * miss + 0.1 * outl), 0), 1) ELSE 0 END AS dq FROM l),
  p AS (SELECT *, CASE WHEN directed THEN CASE WHEN tr IS NULL THEN 'path_unavailable' WHEN tr >= 1.25 AND coalesce(cascade >= 0.35, false) THEN 'path_cascade_transmission' WHEN tr >= 0.65 THEN 'path_baseline_transmission' WHEN tr >= 0.15 THEN 'path_partial_absorption' WHEN tr >= -0.15 THEN 'path_full_absorption_stall'
       WHEN tr <= -0.65 AND (coalesce(dv2 > 0.75, false) OR against = 1) THEN 'path_reversal_takeover' ELSE 'path_pressure_rejection' END
     WHEN ret IS NULL OR az IS NULL THEN 'path_unavailable'
     WHEN context = 'path_mixed_pressure' THEN CASE WHEN chop >= 0.55 OR abs(ret) < 1e-12 OR az < 0.75 THEN 'path_mixed_pressure_chop' WHEN az >= 1.5 AND thigh = 1 THEN 'path_mixed_active_breakout_' || way ELSE 'path_normal_mixed_active_breakout_' || way END
     ELSE CASE WHEN quiet >= 0.6 OR abs(ret) < 1e-12 OR az < 0.75 THEN 'path_quiet_no_pressure' WHEN az >= 1.5 AND thigh = 1 THEN 'path_active_dominance_' || way ELSE 'path_normal_active_dominance_' || way END END AS label,
     CASE WHEN directed THEN CASE WHEN cascade IS NOT NULL THEN greatest(cascade, reject) END WHEN act IS NULL THEN NULL WHEN context = 'path_neutral_pressure' THEN greatest(act, quiet) ELSE greatest(act, chop) END AS margin FROM o),
  z AS (SELECT *, CASE WHEN margin IS NOT NULL THEN least(0.35 * CASE WHEN directed THEN coalesce(least(dirn, 1), 0) ELSE 0 END + 0.3 * margin + 0.2 * CASE WHEN context = 'path_neutral_pressure' THEN quiet ELSE 0 END + 0.2 * CASE WHEN context = 'path_mixed_pressure' THEN chop ELSE 0 END + 0.15 * dq, 1) END AS clarity,
     least(0.3 * CASE WHEN mass / (qm_hi + 1e-9) IS NULL THEN 0 ELSE least(mass / (qm_hi + 1e-9), 1) END + 0.25 * coalesce(least(rv / (qv_hi + 1e-9), 1), 0) + 0.25 * coalesce(least(trd / (qt_hi + 1e-9), 1), 0) + 0.2 * coalesce(least(jmp / (qj_hi + 1e-9), 1), 0), 1) AS activity FROM p)"""


@query(f"""WITH {_path_sql()} SELECT t AS time, n AS window_hours, context, label, {", ".join(f"round(({x})::DOUBLE, 5) + 0.0 AS {y}" for x, y in (("mass", "mass"), ("dirn", "directionality"), ("al", "aligned"), ("cascade", "cascade_score"), ("reject", "rejection_score"),
  ("act", "active_dominance"), ("quiet", "quiet_score"), ("chop", "chop_score"), ("dq", "data_quality"), ("clarity", "signal_clarity"), ("activity", "activity_level"), ("CASE WHEN dv2 IS NOT NULL THEN 100 / (1 + exp(-least(greatest(dv2, -20), 20))) END", "absorption_score"), ("dq * clarity * tanh(least(greatest(ts, -20), 20))", "force_aligned")))} FROM z""")
def path_absorption(spark, sf_dir):
    """Paths of pressure over four windows: context, scores, labels and quality."""
    p = _paths(spark, sf_dir)
    return rounded(p.select("time", "window_hours", "context", "label", "mass", "directionality", "aligned", "cascade_score", "rejection_score", "active_dominance", "quiet_score", "chop_score", "data_quality", "signal_clarity", "activity_level", "absorption_score", "force_aligned"), 5)


def _evidence_sql() -> str:
    wide = ", ".join(f"max({x}) FILTER (n = {n}) AS {y}{n}" for x, y in (("context", "c"), ("label", "l"), ("cascade", "k"), ("dq", "q"), ("clarity", "y"), ("activity", "a")) for n in (6, 12, 24, 48))
    says = lambda x, pattern, wins: [f"coalesce(regexp_matches({x}{n}, '{pattern}'), false)::INT" for n in wins]
    share = lambda x, pattern, wins: f"(({' + '.join(says(x, pattern, wins))}) / {float(len(wins))})"
    most = lambda x, pattern, wins: f"greatest({', '.join(says(x, pattern, wins))})"
    mean = lambda x: f"list_avg(list_filter([{', '.join(f'{x}{n}' for n in (6, 12, 24, 48))}], lambda v: v IS NOT NULL))"
    every, three = (6, 12, 24, 48), (6, 12, 24)
    return f"""{_path_sql()}, w AS (SELECT t, {wide} FROM z GROUP BY t),
  e1 AS (SELECT *, {share("l", "path_quiet_no_pressure", (6, 12))} AS rcq, coalesce({mean("q")}, 0) AS data, coalesce({mean("y")}, 0) AS clar, coalesce({mean("a")}, 1) AS actv, {most("l", "path_reversal_takeover", (12, 24, 48))} AS rt, {most("l", "path_pressure_rejection", (12, 24))} AS rp, {most("l", "path_full_absorption_stall", (12, 24))} AS rf,
    {most("l", "cascade", every)} AS ca, {most("l", "rejection|takeover", every)} AS re, {most("l", "active_dominance|mixed_active_breakout", every)} AS ac, {most("l", "quiet_no_pressure", every)} AS qu, {most("l", "active_dominance", three)} AS va, {most("l", "mixed_active_breakout", three)} AS vb,
    {most("c", "neutral_pressure|mixed_pressure", three)} AS vn, {most("l", "path_cascade_transmission", three)} AS hc, coalesce(greatest(k6, k12, k24), 0) AS hj, {share("c", "path_directional", three)} AS hd, {share("l", "path_partial_absorption|path_baseline_transmission", three)} AS sp FROM w),
  e2 AS (SELECT *, (ca = 1 AND re = 1 OR ac = 1 AND re = 1 OR ca = 1 AND qu = 1)::INT AS conflict, 1 - data AS bad, least(coalesce(y6, 0), 1) * rcq AS rr, 1 - actv AS lv FROM e1),
  e3 AS (SELECT *, 0.25 * rcq + 0.2 * lv + 0.2 * rr + 0.15 * lv + 0.2 * data AS rc, 0.45 * rt + 0.35 * rp + 0.2 * rf AS rha, 0.45 * va + 0.45 * vb + 0.1 * vn AS vt, 0.4 * hc + 0.3 * hj + 0.3 * hd AS hpem, 0.55 * sp + 0.45 * (1 - hj) * sp AS st, 0.6 * (1 - clar) + 0.4 * conflict AS sc FROM e2),
  e4 AS (SELECT *, list_reverse_sort([st, vt, rc, rha, hpem, 0.3 * sc + 0.35 * bad + 0.2 * conflict]) AS first_order FROM e3),
  e5 AS (SELECT *, 0.25 * sc + 0.3 * bad + 0.2 * conflict + 0.15 * (1 - least(greatest(first_order[1] - first_order[2], 0), 1)) AS amb FROM e4),
  e6 AS (SELECT *, list_reverse_sort([st, vt, rc, rha, hpem, amb]) AS o FROM e5)"""


@query(f"""WITH {_evidence_sql()} SELECT t AS time, {", ".join(f"round({x}::DOUBLE, 5) + 0.0 AS score_{x}" for x in ("st", "vt", "rc", "rha", "hpem", "amb"))}, round((o[1] - o[2])::DOUBLE, 5) + 0.0 AS state_margin,
  CASE WHEN o[1] - o[2] < 1e-9 THEN 'tie' WHEN st = o[1] THEN 'ST' WHEN vt = o[1] THEN 'VT' WHEN rc = o[1] THEN 'RC' WHEN rha = o[1] THEN 'RHA' WHEN hpem = o[1] THEN 'HPEM' ELSE 'AMB' END AS state_label FROM e6""")
def path_evidence(spark, sf_dir):
    """Evidence for six states from the paths of all windows; states whose scores differ by rounding alone are a tie."""
    e = rs.state_evidence(rs.multiscale(_paths(spark, sf_dir), ["k"]))
    label = F.when(F.col("state_margin") < 1e-9, "tie").otherwise(F.col("state_label"))
    return rounded(e.select("time", *[f"score_{x.lower()}" for x in rs.STATES], "state_margin", label.alias("state_label")), 5)
