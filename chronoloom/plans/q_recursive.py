"""Queries: recursive filters, regimes, composed features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import DAY, HOUR, ordered
from chronoloom.functions.names import month_folds
from chronoloom.operators import pressure as ps, quantreg, recursive as rc, regime as rg, scans, windows as wn
from chronoloom.plans.registry import BARS, FLOWS, SQL, bars, flows, query, r, rounded, table

I = "i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars)"


@query(f"""WITH RECURSIVE {BARS}, {I}, e(k, i, t, y) AS (SELECT k, i, t, close FROM i WHERE i = 1 UNION ALL SELECT i.k, i.i, i.t, e.y + 2.0 / 13 * (i.close - e.y) FROM e JOIN i ON i.k = e.k AND i.i = e.i + 1) SELECT k, t, round(y, 6) + 0.0 AS y FROM e""")
def ema(spark, sf_dir):
    return rounded(rc.ema(bars(spark, sf_dir), ["k"], ["t"], "close", 12, "y").select("k", "t", "y"))


def _gappy(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("v", F.when(F.col("n") > 1, F.col("close")))


def _ema_sql(weight: str) -> str:
    return f"""WITH RECURSIVE {BARS}, i AS (SELECT k, t, CASE WHEN n > 1 THEN close END AS v, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars),
  e(k, i, t, y, w) AS (SELECT k, i, t, v, 1.0::DOUBLE FROM i WHERE i = 1
    UNION ALL SELECT i.k, i.i, i.t, CASE WHEN i.v IS NULL THEN e.y WHEN e.y IS NULL THEN i.v ELSE (e.w * 0.75 * e.y + 0.25 * i.v) / (e.w * 0.75 + 0.25) END, CASE WHEN i.v IS NULL AND e.y IS NOT NULL THEN {weight} ELSE 1.0 END FROM e JOIN i ON i.k = e.k AND i.i = e.i + 1)
  SELECT k, t, round(y, 6) + 0.0 AS y FROM e"""


@query(_ema_sql("1.0"))
def ema_ignoring_nulls(spark, sf_dir):
    return rounded(rc.ema(_gappy(spark, sf_dir), ["k"], ["t"], "v", 7, "y", ignore_na=True).select("k", "t", sc.finite("y").alias("y")))


@query(_ema_sql("e.w * 0.75"))
def ema_decaying_over_nulls(spark, sf_dir):
    return rounded(rc.ema(_gappy(spark, sf_dir), ["k"], ["t"], "v", 7, "y", ignore_na=False).select("k", "t", sc.finite("y").alias("y")))


@query(f"""WITH RECURSIVE {BARS}, {I}, e(k, i, t, m, p) AS (SELECT k, i, t, 0.49 + 50.0 / 130 * (close - 0.49), 50.0 * 80 / 130 FROM i WHERE i = 1
    UNION ALL SELECT i.k, i.i, i.t, e.m + (e.p + 0.05) / (e.p + 80.05) * (i.close - e.m), 80 * (e.p + 0.05) / (e.p + 80.05) FROM e JOIN i ON i.k = e.k AND i.i = e.i + 1)
  SELECT k, t, round(greatest(m, 0), 6) + 0.0 AS level FROM e""")
def kalman_level(spark, sf_dir):
    return rounded(rc.kalman_level(bars(spark, sf_dir), ["k"], ["t"], "close", "level").select("k", "t", "level"))


@query(f"""WITH RECURSIVE {BARS}, {I}, e(k, i, t, l, s, a, b, c) AS (SELECT k, i, t, ln(1 + close), 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM i WHERE i = 1
    UNION ALL SELECT k, i, t, l + a / (a + 1e-2) * d, s + b / (a + 1e-2) * d, (1 - a / (a + 1e-2)) * a, (1 - a / (a + 1e-2)) * b, c - b / (a + 1e-2) * b FROM
      (SELECT i.k, i.i, i.t, e.l + e.s AS l, e.s, e.a + 2 * e.b + e.c + 1e-4 AS a, e.b + e.c AS b, e.c + 1e-5 AS c, ln(1 + i.close) - e.l - e.s AS d FROM e JOIN i ON i.k = e.k AND i.i = e.i + 1))
  SELECT k, t, round(s, 6) + 0.0 AS slope FROM e""")
def local_slope(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("x", F.log1p("close"))
    return rounded(rc.local_slope(b, ["k"], ["t"], "x", "slope").select("k", "t", "slope"))


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT k, t, close, abs(close - lag(close) OVER w) AS d, abs(close - lag(close, 10) OVER w) AS net, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY k ORDER BY t)),
  a AS (SELECT *, CASE WHEN count(d) OVER f >= 10 THEN pow(net / nullif(sum(d) OVER f, 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) END AS a FROM d WINDOW f AS (PARTITION BY k ORDER BY t ROWS 9 PRECEDING)),
  e(k, i, t, y) AS (SELECT k, i, t, NULL::DOUBLE FROM a WHERE i = 1 UNION ALL SELECT a.k, a.i, a.t, CASE WHEN a.a IS NULL THEN e.y WHEN e.y IS NULL THEN a.close ELSE e.y + a.a * (a.close - e.y) END FROM e JOIN a ON a.k = e.k AND a.i = e.i + 1)
  SELECT k, t, round(y, 6) + 0.0 AS kama, round(ln((close + 1e-9) / (lag(y) OVER (PARTITION BY k ORDER BY t) + 1e-9)), 6) + 0.0 AS spike FROM e JOIN bars USING (k, t)""")
def kama_spike(spark, sf_dir):
    d = rc.kama(bars(spark, sf_dir), ["k"], "t", "close", 10, "kama").withColumn("kama", sc.finite("kama"))
    return rounded(rc.spike(d, ["k"], "t", "close", "kama", "spike").select("k", "t", "kama", "spike"))


@query(f"""WITH {BARS}, g AS (SELECT k, t, close, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars), p AS (SELECT a.k, a.t, sum(exp(-0.5 * pow((a.i - b.i) / (13 / 3.0), 2)) * ln(1 + b.close)) / sum(exp(-0.5 * pow((a.i - b.i) / (13 / 3.0), 2))) AS g FROM g a JOIN g b ON b.k = a.k AND b.i BETWEEN a.i - 12 AND a.i GROUP BY 1, 2)
  SELECT k, t, round(g, 6) + 0.0 AS smooth, round(g - lag(g) OVER w, 6) + 0.0 AS velocity, round(g - 2 * lag(g) OVER w + lag(g, 2) OVER w, 6) + 0.0 AS acceleration FROM p WINDOW w AS (PARTITION BY k ORDER BY t)""")
def gaussian_dynamics(spark, sf_dir):
    w = ordered(["k"], "t")
    d = bars(spark, sf_dir).withColumn("smooth", rc.gaussian_fir(F.log1p("close"), ["k"], "t", 13))
    d = d.withColumn("velocity", F.col("smooth") - F.lag("smooth").over(w))
    return rounded(d.select("k", "t", "smooth", "velocity", (F.col("velocity") - F.lag("velocity").over(w)).alias("acceleration")))


@query(f"""WITH RECURSIVE {BARS}, q AS (SELECT k, quantile_cont(close, 0.9) AS q FROM bars GROUP BY 1), h AS (SELECT b.k, b.t, b.close >= q.q AS h, row_number() OVER (PARTITION BY b.k ORDER BY b.t) AS i FROM bars b JOIN q ON q.k = b.k),
  e(k, i, t, sel, since) AS (SELECT k, i, t, h, CASE WHEN h THEN 1 ELSE 14 END FROM h WHERE i = 1 UNION ALL SELECT h.k, h.i, h.t, h.h AND e.since > 12, CASE WHEN h.h AND e.since > 12 THEN 1 ELSE e.since + 1 END FROM e JOIN h ON h.k = e.k AND h.i = e.i + 1)
  SELECT k, t FROM e WHERE sel""")
def cooldown_events(spark, sf_dir):
    b = bars(spark, sf_dir)
    q = b.groupBy("k").agg(F.percentile("close", 0.9).alias("q"))
    return rc.cooldown_events(b.join(q, "k"), ["k"], ["t"], "close", "q", 12).where("selected").select("k", "t")


@query()
def wavelet_trend(spark, sf_dir):
    return rounded(rc.trailing_wavelet(bars(spark, sf_dir).select("k", "t", "close"), ["k"], ["t"], "close", 128, 3, "trend").select("k", "t", sc.finite("trend").alias("trend")))


def _model() -> rg.Gaussians:
    move = np.full((3, 3), 0.05) + np.eye(3) * 0.85
    return rg.Gaussians(np.full(3, 1 / 3), move, np.array([[3.0], [4.0], [5.0]]), np.full((3, 1), 0.5))


def _density(x: str, m: float) -> str:
    return f"exp(-0.5 * ln(2 * pi() * 0.5) - 0.5 * pow({x} - {m}, 2) / 0.5)"


@query(f"""WITH RECURSIVE {BARS}, i AS (SELECT k, t, ln(1 + close) AS x, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars), d AS (SELECT *, {_density("x", 3)} AS b0, {_density("x", 4)} AS b1, {_density("x", 5)} AS b2 FROM i),
  e(k, i, t, p0, p1, p2) AS (SELECT k, i, t, b0 / (b0 + b1 + b2), b1 / (b0 + b1 + b2), b2 / (b0 + b1 + b2) FROM d WHERE i = 1
    UNION ALL SELECT k, i, t, a0 / (a0 + a1 + a2), a1 / (a0 + a1 + a2), a2 / (a0 + a1 + a2) FROM (SELECT d.k, d.i, d.t, (0.9 * p0 + 0.05 * p1 + 0.05 * p2) * b0 AS a0, (0.05 * p0 + 0.9 * p1 + 0.05 * p2) * b1 AS a1, (0.05 * p0 + 0.05 * p1 + 0.9 * p2) * b2 AS a2 FROM e JOIN d ON d.k = e.k AND d.i = e.i + 1))
  SELECT k, t, {r("p0", "p1", "p2")} FROM e""")
def hmm_filter(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("x", F.log1p("close"))
    return rounded(rg.forward_filter(b, ["k"], ["t"], ["x"], _model()).select("k", "t", "p0", "p1", "p2"))


_AVERAGE_AND_LEVEL = f"""WITH RECURSIVE {BARS}, {I}, e(k, i, t, y) AS (SELECT k, i, t, close FROM i WHERE i = 1 UNION ALL SELECT i.k, i.i, i.t, e.y + 2.0 / 13 * (i.close - e.y) FROM e JOIN i ON i.k = e.k AND i.i = e.i + 1),
  f(k, i, t, m, p) AS (SELECT k, i, t, 0.49 + 50.0 / 130 * (close - 0.49), 50.0 * 80 / 130 FROM i WHERE i = 1
    UNION ALL SELECT i.k, i.i, i.t, f.m + (f.p + 0.05) / (f.p + 80.05) * (i.close - f.m), 80 * (f.p + 0.05) / (f.p + 80.05) FROM f JOIN i ON i.k = f.k AND i.i = f.i + 1),
  g AS (SELECT k, t, n, sum(new) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT k, t, n, CASE WHEN n = lag(n) OVER (PARTITION BY k ORDER BY t) THEN 0 ELSE 1 END AS new FROM bars))
  SELECT k, t, round(y, 6) + 0.0 AS y, round(greatest(m, 0), 6) + 0.0 AS level, row_number() OVER (PARTITION BY k, run ORDER BY t)::DOUBLE AS stood FROM e JOIN f USING (k, i, t) JOIN g USING (k, t)"""


@query(_AVERAGE_AND_LEVEL)
def recurrences_in_chunks(spark, sf_dir):
    """Average, level and run length of each series in one pass over chunks of two days, each the work of a task of its own."""
    parts = [scans.Average(["close"], ["y"], 2 / 13), scans.Level(["close"], ["level"]), scans.RunLength(["n"], ["stood"])]
    return rounded(scans.scan(bars(spark, sf_dir), ["k"], ["t"], parts, chunk=2 * DAY).select("k", "t", "y", "level", "stood"))


@query(_AVERAGE_AND_LEVEL)
def recurrences_resumed(spark, sf_dir):
    """The same, built in two appends: the later rows go on from the states after the earlier ones."""
    b, parts = bars(spark, sf_dir), [scans.Average(["close"], ["y"], 2 / 13), scans.Level(["close"], ["level"]), scans.RunLength(["n"], ["stood"])]
    old, new = b.where(F.col("t") < F.lit("2024-01-15")), b.where(F.col("t") >= F.lit("2024-01-15"))
    states = scans.last_states(old, ["k"], ["t"], parts)
    both = scans.scan(old, ["k"], ["t"], parts).unionByName(scans.scan(new, ["k"], ["t"], parts, states=states))
    return rounded(both.select("k", "t", "y", "level", "stood"))


@query(SQL["hmm_filter"])
def hmm_filter_in_chunks(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("x", F.log1p("close"))
    return rounded(rg.forward_filter(b, ["k"], ["t"], ["x"], _model(), chunk=2 * DAY).select("k", "t", "p0", "p1", "p2"))


@query(SQL["local_slope"])
def local_slope_in_chunks(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("x", F.log1p("close"))
    return rounded(rc.local_slope(b, ["k"], ["t"], "x", "slope", chunk=2 * DAY).select("k", "t", "slope"))


def _best(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def _log_density(m: float) -> str:
    return f"CASE WHEN x IS NULL THEN 0.0 ELSE -0.5 * ln(2 * pi() * 0.5) - 0.5 * pow(x - {m}, 2) / 0.5 END"


@query(f"""WITH RECURSIVE {BARS}, i AS (SELECT k, t, CASE WHEN n > 1 THEN ln(1 + close) END AS x, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars),
  d AS (SELECT *, {_log_density(3)} AS g0, {_log_density(4)} AS g1, {_log_density(5)} AS g2 FROM i),
  e(k, i, t, p0, p1, p2, d0, d1, d2, cur, waiting, cnt, age) AS (
    SELECT k, i, t, exp(g0) / z, exp(g1) / z, exp(g2) / z, g0, g1, g2, {_best("g0", "g1", "g2")}, -1, 0, 1 FROM (SELECT *, exp(g0) + exp(g1) + exp(g2) AS z FROM d WHERE i = 1)
    UNION ALL SELECT k, i, t, p0, p1, p2, d0 - top, d1 - top, d2 - top, CASE WHEN go THEN s ELSE cur END, CASE WHEN go OR calm THEN -1 ELSE s END, CASE WHEN go OR calm THEN 0 ELSE run END, CASE WHEN go THEN 1 ELSE age END FROM
      (SELECT *, NOT calm AND run >= 2 AND age > 1 AS go, greatest(d0, d1, d2) AS top FROM
        (SELECT *, s = cur OR greatest(p0, p1, p2) < 0.6 AS calm, CASE WHEN s = waiting THEN cnt + 1 ELSE 1 END AS run FROM
          (SELECT *, {_best("p0", "p1", "p2")} AS s FROM (SELECT k, i, t, a0 / (a0 + a1 + a2) AS p0, a1 / (a0 + a1 + a2) AS p1, a2 / (a0 + a1 + a2) AS p2, d0, d1, d2, cur, waiting, cnt, age FROM
            (SELECT d.k, d.i, d.t, (0.9 * p0 + 0.05 * p1 + 0.05 * p2) * exp(g0) AS a0, (0.05 * p0 + 0.9 * p1 + 0.05 * p2) * exp(g1) AS a1, (0.05 * p0 + 0.05 * p1 + 0.9 * p2) * exp(g2) AS a2,
              greatest(d0 + ln(0.9), d1 + ln(0.05), d2 + ln(0.05)) + g0 AS d0, greatest(d0 + ln(0.05), d1 + ln(0.9), d2 + ln(0.05)) + g1 AS d1, greatest(d0 + ln(0.05), d1 + ln(0.05), d2 + ln(0.9)) + g2 AS d2, cur, waiting, cnt, age + 1 AS age
             FROM e JOIN d ON d.k = e.k AND d.i = e.i + 1))))))
  SELECT k, t, {_best("p0", "p1", "p2")} AS state, {_best("d0", "d1", "d2")} AS viterbi, cur AS steady, round([p0, p1, p2][cur + 1], 6) + 0.0 AS steady_confidence FROM e""")
def hmm_states(spark, sf_dir):
    """Filtered, prefix-decoded and debounced states of a series with missing values."""
    b = _gappy(spark, sf_dir).withColumn("x", F.log1p("v")).select("k", "t", "x")
    f = rg.forward_filter(b, ["k"], ["t"], ["x"], _model())
    f = rg.prefix_viterbi(f, ["k"], ["t"], ["x"], _model())
    return rounded(rg.debounced(f, ["k"], ["t"], "state", "confidence", 2, 0.6, posteriors=["p0", "p1", "p2"]).select("k", "t", "state", "viterbi", "steady", "steady_confidence"))


@query()
def hmm_trained(spark, sf_dir):
    """A model trained on all rows of one series, relabelled by its first feature, then applied to it."""
    f = flows(spark, sf_dir).withColumn("x", F.log1p(F.col("fl") + F.col("fs")))
    model, _ = rg.relabelled(rg.train(f.select("t", "x"), ["x"], 3, spark, order=["t"]), 0)
    return rounded(rg.forward_filter(f.select("k", "t", "x"), ["k"], ["t"], ["x"], model).select("t", "p0", "p1", "p2", "state"))


PR = f"""WITH {FLOWS}, p AS (SELECT *, CASE WHEN fl + fs > 1e-12 THEN fs / (fl + fs + 1e-12) ELSE 0.5 END AS sh FROM flows), q AS (SELECT *, pow(sh, 4) AS a1, 4 * pow(sh, 3) * (1 - sh) AS a2, 6 * pow(sh, 2) * pow(1 - sh, 2) AS a3, 4 * sh * pow(1 - sh, 3) AS a4, pow(1 - sh, 4) AS a5 FROM p),
  c AS (SELECT *, 0.65 * (a1 + a2 / 2 - a4 / 2 - a5) + 0.35 * (fs - fl) / (fl + fs + 1e-12) AS coordinate, -(a1 * ln(a1 + 1e-12) + a2 * ln(a2 + 1e-12) + a3 * ln(a3 + 1e-12) + a4 * ln(a4 + 1e-12) + a5 * ln(a5 + 1e-12)) AS h FROM q)"""


@query(PR + f""" SELECT t, round(coordinate, 6) + 0.0 AS coordinate, CASE WHEN abs(coordinate) < 0.03 THEN 0 ELSE sign(coordinate) END::INT AS direction, round(least(greatest(abs(coordinate), 0), 1) * least(greatest(1 - h / ln(5), 0), 1), 6) + 0.0 AS reliability FROM c""")
def pressure_features(spark, sf_dir):
    d = _pressure(spark, sf_dir, F.lit(0.0))
    return rounded(d.select("t", "coordinate", "direction", "reliability"))


def _pressure(spark, sf_dir, age=None):
    f = flows(spark, sf_dir).withColumn("sh", sc.safe_ratio("fs", F.col("fl") + F.col("fs"), 0.5))
    f = f.withColumns({f"a{j + 1}": F.lit(float(c)) * F.pow("sh", F.lit(4 - j)) * F.pow(1 - F.col("sh"), F.lit(j)) for j, c in enumerate((1, 4, 6, 4, 1))})
    f = f.withColumn("state", F.floor(F.col("sh") * 4.999).cast("int") + 1).withColumn("age", F.when(F.hour("t") % 11 > 0, 30 * (F.hour("t") % 5)) if age is None else age)
    return ps.pressure_features(f, ["k"], "t", ["a1", "a2", "a3", "a4", "a5"], "fl", "fs", "state", "age")


_CHAIN = ["raw_side", "severity", "coordinate", "log_z", "log_force", "move_severity", "base_reliability", "fresh", "reliability", "log_intensity", "log_accel"]
_AHEAD = (60, 120, 360)
_MOVES = " ".join(f"WHEN '{move}' THEN {v}" for move, v in ps.MOVE_SEVERITY.items())
_LAST = lambda n: f"(PARTITION BY k ORDER BY t ROWS {n - 1} PRECEDING)"
CHAIN = PR + f""", s AS (SELECT *, (fs - fl) / (fl + fs + 1e-12) AS raw_side, a1 + a2 / 2 - a4 / 2 - a5 AS severity, ln(1 + fl + fs) AS lt, floor(sh * 4.999)::INT + 1 AS st, CASE WHEN extract(hour FROM t) % 11 > 0 THEN 30 * (extract(hour FROM t) % 5) END AS age FROM c),
  m AS (SELECT *, list(lt) OVER {_LAST(24)} AS a, quantile_cont(lt, 0.5) OVER {_LAST(24)} AS med, lag(st) OVER (PARTITION BY k ORDER BY t) AS before FROM s),
  z AS (SELECT *, CASE WHEN abs(coordinate) < 0.03 THEN 0 ELSE sign(coordinate) END::INT AS direction, CASE WHEN st IN (1, 5) THEN 1 ELSE 0 END AS strong, CASE WHEN st = before THEN 0 ELSE 1 END AS entered, coalesce(before::VARCHAR, 'NA') || '->' || st AS move,
    coalesce((lt - med) / (1.4826 * CASE WHEN len(a) >= 8 THEN list_aggregate(list_transform(a, lambda v: abs(v - med)), 'quantile_cont', 0.5) END + 1e-12), 0) AS z_total,
    least(abs(coordinate), 1) * least(greatest(1 - h / ln(5), 0), 1) AS base_reliability, exp(-greatest(coalesce(age, 0) - 60, 0) / 60.0) AS fresh FROM m),
  f AS (SELECT *, coordinate * (ln(1 + exp(-abs(z_total))) + greatest(z_total, 0)) AS force, sum(entered) OVER (PARTITION BY k ORDER BY t) AS run FROM z),
  g AS (SELECT *, abs(force) AS intensity, greatest(0, direction * coalesce(force - lag(force) OVER (PARTITION BY k ORDER BY t), 0)) AS accel, row_number() OVER (PARTITION BY k, run ORDER BY t) AS since FROM f),
  u AS (SELECT *, coalesce(CASE WHEN count(accel) OVER {_LAST(24)} >= 3 THEN quantile_cont(accel, 0.5) OVER {_LAST(24)} END, 0) AS usual FROM g),
  chain AS (SELECT *, strong * entered AS strong_entry, (CASE move {_MOVES} ELSE 0 END)::DOUBLE AS move_severity, base_reliability * fresh AS reliability, ln(1 + intensity) AS log_intensity, ln(1 + accel) AS log_accel, sign(z_total) * ln(1 + abs(z_total)) AS log_z, sign(force) * ln(1 + abs(force)) AS log_force,
    CASE WHEN direction = 0 THEN 'neutral' WHEN strong * entered = 1 THEN 'early_strong_entry' WHEN accel > usual THEN 'accelerating' WHEN since >= 24 THEN 'mature' ELSE 'normal' END AS phase FROM u)"""


@query(CHAIN + """ SELECT phase, direction, count(*)::BIGINT AS n, round(avg(log_intensity), 6) + 0.0 AS log_intensity, round(avg(log_accel), 6) + 0.0 AS log_accel FROM chain GROUP BY 1, 2""")
def pressure_phases(spark, sf_dir):
    return _pressure(spark, sf_dir).groupBy("phase", "direction").agg(F.count("*").alias("n"), F.round(F.avg("log_intensity"), 6).alias("log_intensity"), F.round(F.avg("log_accel"), 6).alias("log_accel"))


@query(CHAIN + f""" SELECT c.t, c.direction, c.move, c.strong, c.entered, c.strong_entry, c.phase, {r(*_CHAIN)}, {", ".join(f"round(1e4 * ln(p{m}.price / c.price), 6) + 0.0 AS ret_{m}m_bps, round(direction * 1e4 * ln(p{m}.price / c.price), 6) + 0.0 AS aligned_ret_{m}m_bps" for m in _AHEAD)}
  FROM chain c {" ".join(f"LEFT JOIN flows p{m} ON p{m}.t = c.t + INTERVAL {m} MINUTE" for m in _AHEAD)}""")
def pressure_chain(spark, sf_dir):
    """The pressure chain with its labels at three horizons; z and force as signed logarithms, as they are huge where the scale is 0."""
    log = lambda x: F.signum(x) * F.log1p(F.abs(x))
    d = _pressure(spark, sf_dir).withColumns({"log_z": log("z_total"), "log_force": log("force")})
    d = ps.pressure_labels(d, d.select("k", "t", "price"), ["k"], "t", "price", _AHEAD)
    return rounded(d.select("t", "direction", "move", "strong", "entered", "strong_entry", "phase", *_CHAIN, *[f"{p}ret_{m}m_bps" for m in _AHEAD for p in ("", "aligned_")]))


@query(f"""WITH RECURSIVE {BARS}, ev AS (SELECT event_type AS k, ts + INTERVAL 30 MINUTE AS av, 100 * (event_id % 101) / 100.0 AS sc, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
  e(k, i, av, y) AS (SELECT k, i, av, sc FROM ev WHERE i = 1 UNION ALL SELECT ev.k, ev.i, ev.av, e.y + 2.0 / 13 * (ev.sc - e.y) FROM e JOIN ev ON ev.k = e.k AND ev.i = e.i + 1), l AS (SELECT k, av, arg_max(y, i) AS y FROM e GROUP BY 1, 2)
  SELECT b.k, b.t, round(CASE WHEN l.y IS NULL THEN 50 ELSE 50 + pow(2, -(epoch_us(b.t) - epoch_us(l.av)) / 3600000000.0 / 24) * (l.y - 50) END, 6) + 0.0 AS memory FROM bars b ASOF LEFT JOIN l ON l.k = b.k AND b.t >= l.av""")
def matured_memory(spark, sf_dir):
    """Memory of every event."""
    return _memory(spark, sf_dir, table(spark, sf_dir, "events"))


@query()
def matured_memory_whole(spark, sf_dir):
    """Memory of every event, as ``matured_memory``; a test holds it against brute force."""
    return _memory(spark, sf_dir, table(spark, sf_dir, "events"))


def _memory(spark, sf_dir, events):
    ev = events.select(F.col("event_type").alias("k"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("av"), (100 * (F.col("event_id") % 101) / 100.0).alias("sc"), "event_id")
    return rounded(ps.matured_memory(bars(spark, sf_dir).select("k", "t"), ev, ["k"], "t", "av", "sc", 12, 24, tie=["event_id"]).select("k", "t", "memory"))


@query()
def quantile_regression(spark, sf_dir):
    """Slopes kept non-negative, and the coverage they reach."""
    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    a, b = quantreg.fit(l, ["l_quantity", "l_discount"], "l_extendedprice", 0.65)
    size, _ = ps.score_model(b, a, F.lit(1.0), F.lit(1))
    return l.agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_extendedprice") <= size).cast("double")), 3).alias("coverage"))


@query()
def walk_forward(spark, sf_dir):
    """Folds of 18 and 3 months, every 3 months, three targets: all fits in common rounds."""
    month = F.month("o_orderdate").cast("double")
    price = F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select("o_orderdate", month.alias("x"), F.dayofmonth("o_orderdate").cast("double").alias("day"), price.alias("price"), (price * (1 + month / 24)).alias("rising"), (price - 150000).alias("centred"))
    ends = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    rows = quantreg.walk_forward(o, "o_orderdate", month_folds(str(ends[0]), str(ends[1])), ["x", "day"], ["price", "rising", "centred"])
    kinds = "fold int, target string, start string, cut string, intercept double, x double, day double, n_train long, n_test long, skipped boolean, mean_predicted double, mean_actual double, positive_rate double, coverage double, pinball double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)


@query()
def liquidity_price_features(spark, sf_dir):
    """Adaptive spike, Gaussian dynamics, local slope and volatility blend of one series."""
    w = ordered(["k"], "t")
    f = flows(spark, sf_dir).withColumn("x", F.log1p(F.col("fl") + F.col("fs"))).withColumn("ret", sc.log_return_bps(F.col("price"), F.lag("price").over(w)))
    f = rc.local_slope(rc.spike(rc.kama(f, ["k"], "t", "x", 24, "kama"), ["k"], "t", "x", "kama", "spike"), ["k"], ["t"], "x", "slope")
    f = f.withColumn("smooth", rc.gaussian_fir(F.col("x"), ["k"], "t", 13)).withColumn("velocity", F.col("smooth") - F.lag("smooth").over(w))
    fast, slow = (F.stddev_samp("ret").over(w.rowsBetween(1 - n, 0)) for n in (6, 24))
    weight = sc.clip(sc.sigmoid(3 * (sc.divide(fast, slow) - 1)), 0.3, 1.0)
    return rounded(f.select("t", *[sc.finite(c).alias(c) for c in ("spike", "slope", "smooth", "velocity")], (weight * fast + (1 - weight) * slow).alias("blend")))
