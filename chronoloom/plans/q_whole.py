"""Queries: whole feature chains and diagnostics with their SQL: price features of two sides, dominance, densities, outliers, order of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import aggregates as ag, checks as ck, regime as rg, stages as st
from chronoloom.plans.registry import BARS, FLOWS, bars, flows, query, r, rounded, table

PRICE = ["long_spike", "short_spike", "long_velocity", "long_acceleration", "short_velocity", "short_acceleration", "trend_pressure", "kalman_slope", "vol_adaptive"]


def _price_sql() -> str:
    kama = lambda side, x: f"""{side}(i, y) AS (SELECT i, {x} FROM x WHERE i = 1 UNION ALL SELECT x.i, CASE WHEN a_{x} IS NULL THEN y ELSE y + a_{x} * ({x} - y) END FROM {side} JOIN x ON x.i = {side}.i + 1)"""
    alpha = lambda x: f"CASE WHEN i > 24 THEN pow(CASE WHEN path_{x} = 0 THEN 0 ELSE abs({x} - lag({x}, 24) OVER w) / path_{x} END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) END AS a_{x}"
    smooth = lambda x: f"CASE WHEN i = 1 THEN ln(1 + {x}) ELSE (ln(1 + {x}) + exp(-0.5) * ln(1 + lag({x}) OVER w)) / (1 + exp(-0.5)) END AS g_{x}"
    vol = lambda n: f"CASE WHEN count(ret) OVER (ORDER BY i ROWS {n - 1} PRECEDING) >= {max(3, n // 3)} THEN stddev_samp(ret) OVER (ORDER BY i ROWS {n - 1} PRECEDING) END AS v{n}"
    return f"""WITH RECURSIVE {FLOWS}, b AS (SELECT t, fl, fs, ln(greatest(price, 1e-12)) AS l, row_number() OVER (ORDER BY t) AS i FROM flows),
  p AS (SELECT *, l - lag(l) OVER (ORDER BY i) AS ret, l - lag(l, 3) OVER (ORDER BY i) AS mom, abs(fl - lag(fl) OVER (ORDER BY i)) AS d_fl, abs(fs - lag(fs) OVER (ORDER BY i)) AS d_fs FROM b),
  q AS (SELECT *, sum(d_fl) OVER (ORDER BY i ROWS 23 PRECEDING) AS path_fl, sum(d_fs) OVER (ORDER BY i ROWS 23 PRECEDING) AS path_fs FROM p),
  x AS (SELECT *, {alpha("fl")}, {alpha("fs")}, {smooth("fl")}, {smooth("fs")}, {vol(12)}, {vol(6)}, {vol(24)} FROM q WINDOW w AS (ORDER BY i)),
  {kama("ka", "fl")}, {kama("kb", "fs")},
  k(i, lv, s, a, b, c) AS (SELECT i, l, 0.0::DOUBLE, (2 + 1e-6) * 1e-4 / (2 + 1e-6 + 1e-4), 1.0 * (1 - (2 + 1e-6) / (2 + 1e-6 + 1e-4)), 1 + 1e-7 - 1.0 / (2 + 1e-6 + 1e-4) FROM x WHERE i = 1
    UNION ALL SELECT i, l + a / (a + 1e-4) * e, s + b / (a + 1e-4) * e, (1 - a / (a + 1e-4)) * a, (1 - a / (a + 1e-4)) * b, c - b / (a + 1e-4) * b FROM
      (SELECT x.i, k.lv + k.s AS l, k.s, k.a + 2 * k.b + k.c + 1e-6 AS a, k.b + k.c AS b, k.c + 1e-7 AS c, x.l - k.lv - k.s AS e FROM k JOIN x ON x.i = k.i + 1)),
  z AS (SELECT x.*, ka.y AS ya, kb.y AS yb, k.s AS slope, g_fl - lag(g_fl) OVER (ORDER BY x.i) AS lv1, g_fs - lag(g_fs) OVER (ORDER BY x.i) AS sv1 FROM x JOIN ka USING (i) JOIN kb USING (i) JOIN k USING (i)),
  f AS (SELECT t, ln((fl + 1e-12) / (lag(ya) OVER w + 1e-12)) AS long_spike, ln((fs + 1e-12) / (lag(yb) OVER w + 1e-12)) AS short_spike, lv1 AS long_velocity, lv1 - lag(lv1) OVER w AS long_acceleration, sv1 AS short_velocity, sv1 - lag(sv1) OVER w AS short_acceleration,
     mom / (sqrt(3.0) * (v12 + 1e-12)) AS trend_pressure, slope AS kalman_slope, 0.3 + 0.7 / (1 + exp(-least(greatest(3 * ln((v6 + 1e-12) / (v24 + 1e-12)), -40), 40))) AS wt, v6, v24 FROM z WINDOW w AS (ORDER BY i))
  SELECT t, {r(*PRICE[:-1], digits=5)}, round(wt * v6 + (1 - wt) * v24, 5) + 0.0 AS vol_adaptive FROM f"""


@query(_price_sql())
def liquidity_price_whole(spark, sf_dir):
    """All nine features of the price and both sides."""
    f = st.liquidity_price(flows(spark, sf_dir), ["k"], "t", "price", "fl", "fs", 60)
    return rounded(f.select("t", *PRICE), 5)


def _dominance_sql() -> str:
    beta = lambda n: "(" + " + ".join(f"{(n - 1) / 2 - k} * lag(diff, {k}) OVER w" if k else f"{(n - 1) / 2} * diff" for k in range(n)) + f") / {n * (n * n - 1) / 12} AS beta_{n}"
    thr = lambda x, p, name: f"CASE WHEN count({x}) OVER v >= 24 THEN quantile_cont({x}, {p}) OVER v END AS {name}"
    repeat = lambda x, name: f"CASE WHEN coalesce(lag({x}) OVER w = {x}, false) OR coalesce(lag({x}, 2) OVER w = {x}, false) OR coalesce(lag({x}, 3) OVER w = {x}, false) THEN 0 ELSE {x} END AS {name}"
    before = "OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {FLOWS}, a AS (SELECT *, fl - fs AS diff, CASE WHEN fl + fs > 1e-12 THEN fl / (fl + fs + 1e-12) ELSE 0.5 END AS rpn, row_number() OVER (ORDER BY t) AS i FROM flows),
  h AS (SELECT *, CASE WHEN i > 72 THEN (i - 73) // 24 END AS g FROM a), e AS (SELECT x.g, quantile_cont(y.diff, [{", ".join(f"{j}/9" for j in range(1, 9))}]) AS edges FROM (SELECT DISTINCT g FROM h WHERE g IS NOT NULL) x JOIN a y ON y.i <= 72 + 24 * x.g GROUP BY 1),
  b AS (SELECT h.*, CASE WHEN edges IS NULL THEN 4 ELSE len(list_filter(edges, lambda q: q <= diff)) END AS bin FROM h LEFT JOIN e USING (g)),
  c AS (SELECT *, {thr("diff", 0.8, "thr_pos")}, {thr("diff", 0.2, "thr_neg")}, {thr("diff", 0.6, "pos_base")}, {thr("diff", 0.4, "neg_base")}, {thr("fl", 0.8, "long_high")}, {thr("fs", 0.8, "short_high")}, {beta(3)}, {beta(8)}, {beta(10)}, {beta(24)}, abs(diff - lag(diff) OVER w) AS step FROM b WINDOW v AS (ORDER BY i ROWS 95 PRECEDING), w AS (ORDER BY i)),
  d AS (SELECT *, CASE WHEN bin <= 3 AND diff <= thr_neg OR bin = 4 AND rpn <= 0.48 AND diff <= neg_base THEN 1 WHEN bin >= 5 AND diff >= thr_pos OR bin = 4 AND rpn >= 0.52 AND diff >= pos_base THEN -1 ELSE 0 END AS dominance FROM c),
  f AS (SELECT *, coalesce(lag(dominance) OVER (ORDER BY i), 0) AS prev, coalesce(last_value(CASE WHEN dominance <> 0 THEN dominance END IGNORE NULLS) {before}, 0) AS last, last_value(CASE WHEN dominance <> 0 THEN dominance END IGNORE NULLS) OVER (ORDER BY i) AS side, lag(beta_3) OVER (ORDER BY i) AS bp FROM d),
  g AS (SELECT *, sum((i = 1 OR dominance <> prev)::INT) OVER (ORDER BY i) AS run, sum((i = 1 OR side IS DISTINCT FROM nullif(last, 0))::INT) OVER (ORDER BY i) AS super, (dominance <> 0 AND (i = 1 OR dominance <> prev))::INT AS entry,
     CASE WHEN dominance = 1 AND diff <= thr_neg AND fs >= short_high AND bp < 0 AND beta_3 >= 0 THEN -1 WHEN dominance = -1 AND diff >= thr_pos AND fl >= long_high AND bp > 0 AND beta_3 <= 0 THEN 1 ELSE 0 END AS hit FROM f),
  k AS (SELECT *, i - max(CASE WHEN hit <> 0 THEN i END) {before} AS since, last_value(CASE WHEN hit <> 0 THEN diff END IGNORE NULLS) {before} AS at_, last_value(CASE WHEN hit <> 0 THEN hit END IGNORE NULLS) {before} AS kind FROM g),
  m AS (SELECT *, CASE WHEN since BETWEEN 1 AND 8 AND kind = -1 AND diff <= at_ - 0.2 THEN 1 WHEN since BETWEEN 1 AND 8 AND kind = 1 AND diff >= at_ + 0.2 THEN -1 ELSE 0 END AS back FROM k)
  SELECT t, bin::INT AS bin, dominance, round(beta_3, 6) + 0.0 AS beta_3, round(beta_24, 6) + 0.0 AS beta_24, round(max(step) OVER (ORDER BY i ROWS 23 PRECEDING), 6) + 0.0 AS max_variation, round(thr_pos - thr_neg, 6) + 0.0 AS thr_range, row_number() OVER (PARTITION BY run ORDER BY i) AS dominance_duration,
    last AS dominance_last, CASE dominance WHEN 1 THEN 'Bull' WHEN -1 THEN 'Bear' ELSE 'Congestion' END AS dominance_class, (dominance <> 0 AND dominance = prev)::INT AS is_keep, (dominance <> 0 AND dominance = last)::INT AS is_strengthen,
    CASE WHEN dominance <> 0 THEN sum(entry) OVER (PARTITION BY super ORDER BY i) ELSE 0 END::BIGINT AS dominance_time, {repeat("hit", "hit_ceiling_bottom")}, {repeat("back", "reverse_ceiling_bottom")} FROM m WINDOW w AS (ORDER BY i)"""


@query(_dominance_sql())
def dominance_chain(spark, sf_dir):
    """The whole chain of dominance over real bins: slopes, runs, entries, hits and reversals."""
    d = st.dominance(flows(spark, sf_dir), ["k"], "t", "fl", "fs", st.DominanceSettings(96, 24, 72, 24))
    return rounded(d.select("t", F.col("bin").cast("int").alias("bin"), "dominance", "beta_3", "beta_24", "max_variation", "thr_range", "dominance_duration", "dominance_last", "dominance_class", "is_keep", "is_strengthen", "dominance_time", "hit_ceiling_bottom", "reverse_ceiling_bottom"))


@query("""WITH s AS (SELECT event_type AS k, count(*) AS n, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS bw, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1),
  b AS (SELECT k, floor((value - lo) / (bw / 20)) AS bin, count(*) AS c, avg(value) AS m FROM events JOIN s ON s.k = event_type WHERE value BETWEEN lo - 6 * bw AND hi + 6 * bw GROUP BY 1, 2),
  g AS (SELECT s.*, range AS point, lo + (hi - lo) * range / 219 AS x FROM s CROSS JOIN range(220))
  SELECT k, point::INT AS point, round(x, 6) + 0.0 AS x, round(sum(c * exp(-0.5 * pow((x - m) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) + 0.0 AS density FROM g JOIN b USING (k) GROUP BY k, point, x""")
def kernel_density(spark, sf_dir):
    d = ag.kernel_density(table(spark, sf_dir, "events").withColumnRenamed("event_type", "k"), ["k"], "value")
    return d.select("k", "point", (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("density", 8) + F.lit(0.0)).alias("density"))


_MARKS = f"""WITH {BARS}, a AS (SELECT k, t, close AS x, abs(close - lag(close) OVER (PARTITION BY k ORDER BY t)) AS step FROM bars),
  s AS (SELECT k, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.25) AS q1, median(x) AS mid, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.01) AS extreme_low, quantile_cont(x, 0.99) AS extreme_high, median(step) AS smid FROM a GROUP BY 1),
  m AS (SELECT k, median(abs(x - mid)) AS mad, median(abs(step - smid)) AS smad FROM a JOIN s USING (k) GROUP BY 1),
  b AS (SELECT a.*, s.*, (x - mean) / sd AS z, q1 - 1.5 * (q3 - q1) AS iqr_low, q3 + 1.5 * (q3 - q1) AS iqr_high, abs(mid) + 5 * greatest(mad, 1e-12) AS explosion_threshold, smid + 4 * greatest(smad, 1e-12) AS cliff_threshold FROM a JOIN s USING (k) JOIN m USING (k)),
  f AS (SELECT *, abs(z) > 2.5 AS b1, x < iqr_low OR x > iqr_high AS b2, x < extreme_low OR x > extreme_high AS b3, abs(x) > explosion_threshold AS b4, coalesce(step > cliff_threshold, false) AS b5 FROM b)"""
_LIMITS = ck.OutlierLimits(2.5, 1.5, (0.01, 0.99), 5.0, 4.0)


@query(_MARKS + f""" SELECT k, count(*) AS n, {", ".join(f"round(any_value({c}), 6) + 0.0 AS {c}" for c in ("iqr_low", "iqr_high", "extreme_low", "extreme_high", "explosion_threshold", "cliff_threshold"))},
  {", ".join(f"sum(b{i + 1}::INT)::BIGINT AS n_{name}" for i, name in enumerate(ck.OUTLIER_REASONS))} FROM f GROUP BY k""")
def outlier_counts(spark, sf_dir):
    """Deviations, quartiles, tails, explosions and cliffs of each series, with their thresholds."""
    return rounded(ck.outlier_counts(ck.outlier_marks(bars(spark, sf_dir), ["k"], "t", "close", _LIMITS), ["k"]))


@query(_MARKS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(z) DESC, t) AS place FROM f WHERE b1 OR b2 OR b3 OR b4 OR b5)
  SELECT k, place::INT AS place, t, round(x, 6) + 0.0 AS close, round(z, 6) + 0.0 AS z, concat_ws(',', {", ".join(f"CASE WHEN b{i + 1} THEN '{name}' END" for i, name in enumerate(ck.OUTLIER_REASONS))}) AS reason FROM o WHERE place <= 30""")
def outlier_worst(spark, sf_dir):
    """The thirty worst rows of each series with their reasons."""
    return rounded(ck.outlier_examples(ck.outlier_marks(bars(spark, sf_dir), ["k"], "t", "close", _LIMITS), ["k"], "t", "close"))


@query(f"""WITH {FLOWS}, a AS (SELECT fl, fs, fl + fs AS total, fs - fl AS lean, floor((extract(hour FROM t) * 7 + extract(day FROM t)) % 5)::INT AS state FROM flows),
  s AS (SELECT state, count(*) AS n, median(total) AS total_med, quantile_cont(total, 0.9) AS total_p90, median(lean) AS short_dom_med, avg(lean) AS short_dom_mean, median(fl) AS long_med, median(fs) AS short_med, median(fs / (total + 1e-12)) AS short_share_med FROM a GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY abs(short_dom_med), total_med, state) = 1 AS near FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY short_dom_med DESC, total_med DESC, state) AS place FROM o),
  q AS (SELECT *, CASE WHEN near THEN 3 WHEN place > 2 THEN place + 1 ELSE place END::INT AS new_state FROM p)
  SELECT state, new_state, n, {r("total_med", "total_p90", "short_dom_med", "short_dom_mean", "long_med", "short_med", "short_share_med")}, CASE WHEN new_state < 3 THEN short_dom_med > 0 WHEN new_state > 3 THEN short_dom_med < 0 ELSE true END AS sign_ok, round(n / sum(n) OVER (), 6) + 0.0 AS share FROM q""")
def state_order(spark, sf_dir):
    """States put in order by their medians, the neutral one in the middle."""
    f = flows(spark, sf_dir).withColumn("state", ((F.hour("t") * 7 + F.dayofmonth("t")) % 5).cast("int"))
    return rounded(rg.neutral_first(rg.pressure_medians(f, "state", "fl", "fs")))


_CLEAN = ["long_level", "short_level", "total_level", "diff_level", "share", "dominance_share"]


def _clean_sql() -> str:
    side = lambda n, x: f"""q_{n} AS (SELECT t, i, {x} AS x, quantile_cont({x}, 0.25) OVER w AS q1, quantile_cont({x}, 0.75) OVER w AS q3, max({x}) OVER w AS top FROM raw WINDOW w AS (ORDER BY t RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW)),
  v_{n} AS (SELECT t, i, CASE WHEN x > q3 + 1.5 * (q3 - q1) THEN coalesce(q3 + 2.5 * (q3 - q1) * (x - q3) / nullif(top - q3, 0), q3 + 1.5 * (q3 - q1)) ELSE x END AS v FROM q_{n}),
  n_{n} AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, last_value(v IGNORE NULLS) OVER p AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ib, first_value(v IGNORE NULLS) OVER n AS vb FROM v_{n}
    WINDOW p AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  {n} AS (SELECT t, greatest(coalesce(v, va + (vb - va) * (i - ia) / nullif(ib - ia, 0), va), 0) AS {n} FROM n_{n} WHERE coalesce(v, va) IS NOT NULL)"""  # noqa: E731
    return f"""WITH {FLOWS}, raw AS (SELECT t, price, CASE WHEN extract(hour FROM t) % 7 <> 3 THEN fl END AS a, CASE WHEN extract(hour FROM t) % 5 <> 0 THEN fs END AS b, row_number() OVER (ORDER BY t) AS i FROM flows WHERE t >= TIMESTAMP '2024-01-03'),
  {side("l", "a")}, {side("s", "b")}, j AS (SELECT t, price, l AS long_level, s AS short_level, l + s AS total_level, l - s AS diff_level FROM raw LEFT JOIN l USING (t) LEFT JOIN s USING (t))
  SELECT t, price, {r(*_CLEAN[:4])}, round(CASE WHEN total_level > 1e-12 THEN long_level / (total_level + 1e-12) ELSE 0.5 END, 6) + 0.0 AS share,
    round(CASE WHEN total_level > 1e-12 THEN diff_level / (total_level + 1e-12) ELSE 0 END, 6) + 0.0 AS dominance_share, CASE WHEN total_level > 0 THEN 1 ELSE 0 END AS active FROM j"""


@query(_clean_sql())
def clean_frame(spark, sf_dir):
    """Raw sides with gaps, capped over seven days, filled and put together."""
    f = flows(spark, sf_dir).select("k", "t", "price", F.when(F.hour("t") % 7 != 3, F.col("fl")).alias("raw_long"), F.when(F.hour("t") % 5 != 0, F.col("fs")).alias("raw_short"))
    out = st.clean_frame(f, ["k"], "t", days=7, factor=1.5, start="2024-01-03")
    return rounded(out.select("t", "price", *_CLEAN, "active"))


@query("""WITH c AS (SELECT count(*) FILTER (ts IS NULL) AS unknown, count(*) FILTER (ts IS NOT NULL) - count(DISTINCT ts) AS twice, count(*) FILTER (value < 0) AS negative, count(*) FILTER (isinf(value) OR isnan(value)) AS odd, count(*) AS n FROM events)
  SELECT 'table_exists' AS "check", 0::BIGINT AS n_bad, 1::BIGINT AS n_rows, 'PASS' AS status UNION ALL SELECT 'ts_known', unknown, n, CASE WHEN unknown = 0 THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL SELECT 'ts_unique', twice, n, CASE WHEN twice = 0 THEN 'PASS' ELSE 'FAIL' END FROM c
  UNION ALL SELECT 'value_not_negative', negative, n, CASE WHEN negative = 0 THEN 'PASS' ELSE 'FAIL' END FROM c UNION ALL SELECT 'value_finite', odd, n, CASE WHEN odd = 0 THEN 'PASS' ELSE 'FAIL' END FROM c""")
def cache_report(spark, sf_dir):
    """Whether a stored table is there, its times are known and unique, its numbers finite and not negative."""
    return ck.cache_report(spark, f"{sf_dir}/events.parquet", [], "ts", ["value"])
