"""Queries: windows over rows and over time, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, HOUR, ordered, rows, span
from chronoloom.functions.scalar import c_ln
from chronoloom.operators import islands, ranks, time_windows as tw, windows as wn
from chronoloom.plans.registry import BARS, FLOWS, bars, flows, query, r, rounded

W = "(PARTITION BY k ORDER BY t ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def rn(n: int) -> str:
    """SQL frame of the last n rows."""
    return W.format(n=n - 1)


def tn(us: int) -> str:
    """SQL frame of the span (t - d, t]."""
    return f"(PARTITION BY k ORDER BY epoch_us(t) RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {BARS} SELECT k, t, {r("d1", "d24")}, next_n FROM (SELECT k, t, close - lag(close) OVER w AS d1, close - lag(close, 24) OVER w AS d24, lead(n) OVER w AS next_n FROM bars WINDOW w AS (PARTITION BY k ORDER BY t))""")
def lag_diff(spark, sf_dir):
    w = ordered(["k"], "t")
    return rounded(bars(spark, sf_dir).select("k", "t", (F.col("close") - F.lag("close").over(w)).alias("d1"), (F.col("close") - F.lag("close", 24).over(w)).alias("d24"), F.lead("n").over(w).alias("next_n")))


@query(f"""WITH {BARS} SELECT k, t, {r("s", "m", "sd")}, c FROM (SELECT k, t, sum(close) OVER {rn(12)} AS s, CASE WHEN count(close) OVER {rn(12)} >= 6 THEN avg(close) OVER {rn(12)} END AS m,
  CASE WHEN count(close) OVER {rn(12)} >= 6 THEN stddev_samp(close) OVER {rn(12)} END AS sd, count(close) OVER {rn(12)} AS c FROM bars)""")
def rolling_stats(spark, sf_dir):
    from chronoloom.functions.frames import at_least

    w, x = rows(["k"], "t", 12), F.col("close")
    return rounded(bars(spark, sf_dir).select("k", "t", F.sum(x).over(w).alias("s"), at_least(F.avg(x).over(w), x, w, 6).alias("m"), at_least(F.stddev_samp(x).over(w), x, w, 6).alias("sd"), F.count(x).over(w).alias("c")))


@query(f"""WITH {BARS} SELECT k, t, {r("q20", "q50", "q80")} FROM (SELECT k, t, {", ".join(f"CASE WHEN count(close) OVER {rn(24)} >= 12 THEN quantile_cont(close, {q}) OVER {rn(24)} END AS q{int(q * 100)}" for q in (0.2, 0.5, 0.8))} FROM bars)""")
def rolling_quantile(spark, sf_dir):
    return rounded(ranks.rolling_quantiles(bars(spark, sf_dir), ["k"], "t", "close", {"q20": 0.2, "q50": 0.5, "q80": 0.8}, least=12, rows=24).select("k", "t", "q20", "q50", "q80"))


@query(f"""WITH {BARS}, m AS (SELECT k, t, close, CASE WHEN count(close) OVER {rn(24)} >= 20 THEN quantile_cont(close, 0.5) OVER {rn(24)} END AS med FROM bars), d AS (SELECT *, abs(close - med) AS dev FROM m)
  SELECT k, t, {r("z")} FROM (SELECT k, t, (close - med) / nullif(1.4826 * CASE WHEN count(dev) OVER {rn(24)} >= 20 THEN quantile_cont(dev, 0.5) OVER {rn(24)} END, 0) AS z FROM d)""")
def nested_mad_z(spark, sf_dir):
    return rounded(wn.nested_mad_z(bars(spark, sf_dir), ["k"], "t", "close", 24, 20, "z").select("k", "t", "z"))


@query(f"""WITH {BARS}, a AS (SELECT k, t, close, list(close) OVER {rn(24)} AS a, quantile_cont(close, 0.5) OVER {rn(24)} AS med FROM bars)
  SELECT k, t, {r("z")} FROM (SELECT k, t, coalesce((close - med) / nullif(1.4826 * CASE WHEN len(a) >= 8 THEN list_aggregate(list_transform(a, lambda v: abs(v - med)), 'quantile_cont', 0.5) END, 0), 0) AS z FROM a)""")
def true_mad_z(spark, sf_dir):
    return rounded(wn.true_mad_z(bars(spark, sf_dir), ["k"], "t", "close", 24, 8, "z").select("k", "t", "z"))


@query(f"""WITH {BARS}, x AS (SELECT k, t, lag(close, 3) OVER (PARTITION BY k ORDER BY t) AS x FROM bars), m AS (SELECT *, CASE WHEN count(x) OVER {rn(168)} >= 48 THEN quantile_cont(x, 0.5) OVER {rn(168)} END AS med FROM x), d AS (SELECT *, abs(x - med) AS dev FROM m)
  SELECT k, t, {r("sigma", digits=8)} FROM (SELECT k, t, coalesce(1.4826 * CASE WHEN count(dev) OVER {rn(168)} >= 48 THEN quantile_cont(dev, 0.5) OVER {rn(168)} END, CASE WHEN count(x) OVER e >= 12 THEN stddev_samp(x) OVER e END) AS sigma FROM d WINDOW e AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING))""")
def matured_sigma(spark, sf_dir):
    return rounded(wn.matured_sigma(bars(spark, sf_dir), ["k"], "t", "close", 3, 168, 48, 12, "sigma").select("k", "t", "sigma"), 8)


@query(f"""WITH {BARS}, i AS (SELECT k, t, close, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars) SELECT k, t, {r("slope")} FROM (SELECT k, t, CASE WHEN count(*) OVER {rn(8)} = 8 THEN regr_slope(close, i) OVER {rn(8)} END AS slope FROM i)""")
def rolling_slope(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("k", "t", wn.rolling_slope(F.col("close"), ["k"], "t", 8).alias("slope")))


@query(f"""WITH {BARS}, l AS (SELECT k, t, (n * 7 + extract(hour FROM t)) % 9 AS lv, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars),
  m AS (SELECT k, t, {", ".join(f"max(CASE WHEN lv = {v} THEN i END) OVER {rn(48)} AS m{v}" for v in (8, 4, 0, 5))} FROM l)
  SELECT k, t, CASE WHEN m8 IS NOT NULL AND coalesce(m4, -1) < m8 THEN -1 WHEN m0 IS NOT NULL AND coalesce(m5, -1) < m0 THEN 1 ELSE 0 END AS flag FROM m""")
def extreme_flag(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("lv", (F.col("n") * 7 + F.hour("t")) % 9)
    return wn.extreme_flag(b, ["k"], "t", "lv", 48).select("k", "t", "flag")


@query(f"""WITH {BARS}, i AS (SELECT k, t, close, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM bars), g AS (SELECT *, CASE WHEN i >= 72 THEN (i - 72) // 24 END AS g FROM i),
  e AS (SELECT a.k, a.g, quantile_cont(b.close, [{", ".join(str(j) + "/9" for j in range(1, 9))}]) AS edges FROM (SELECT DISTINCT k, g FROM g WHERE g IS NOT NULL) a JOIN i b ON b.k = a.k AND b.i < 72 + 24 * a.g GROUP BY 1, 2)
  SELECT g.k, g.t, CASE WHEN edges IS NULL THEN 4 ELSE len(list_filter(edges, lambda q: q <= close)) END AS bin FROM g LEFT JOIN e ON e.k = g.k AND e.g = g.g""")
def point_in_time_bins(spark, sf_dir):
    return ranks.expanding_bins(bars(spark, sf_dir), ["k"], "t", "close", 9, 72, 24, 4, "bin").select("k", "t", "bin")


SIDE = """s AS (SELECT k, t, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS s, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars)"""


def _side(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("s", F.signum(F.col("close") - F.col("open")).cast("int"))


@query(f"""WITH {BARS}, {SIDE}, c AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS c FROM s WINDOW w AS (PARTITION BY k ORDER BY t)), j AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY t) AS j FROM c)
  SELECT k, t, row_number() OVER (PARTITION BY k, j ORDER BY t) AS run FROM j""")
def run_length(spark, sf_dir):
    return islands.run_length(_side(spark, sf_dir), ["k"], "t", "s", "run").select("k", "t", "run")


@query(f"""WITH {BARS}, {SIDE} SELECT k, t, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS side,
  i - max(CASE WHEN s = 1 THEN i END) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM s""")
def last_nonzero_and_since(spark, sf_dir):
    d = islands.rows_since(_side(spark, sf_dir), ["k"], "t", F.col("s") == 1, "since")
    return d.select("k", "t", islands.last_matching(F.col("s"), F.col("s") != 0, ["k"], "t").alias("side"), "since")


@query(f"""WITH {BARS}, {SIDE}, e AS (SELECT *, CASE WHEN s <> 0 AND (lag(s) OVER w IS DISTINCT FROM s) THEN 1 ELSE 0 END AS e, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS side FROM s WINDOW w AS (PARTITION BY k ORDER BY t)),
  c AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER w AND i > 1 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY k ORDER BY t)), g AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY t) AS g FROM c)
  SELECT k, t, CASE WHEN s <> 0 THEN sum(e) OVER (PARTITION BY k, g ORDER BY t)::BIGINT ELSE 0 END AS entries FROM g""")
def entry_counter(spark, sf_dir):
    return islands.entry_counter(_side(spark, sf_dir), ["k"], "t", "s", "entries").select("k", "t", "entries")


@query(f"""WITH {BARS}, {SIDE} SELECT k, t, CASE WHEN coalesce(lag(s) OVER w = s, false) OR coalesce(lag(s, 2) OVER w = s, false) OR coalesce(lag(s, 3) OVER w = s, false) THEN 0 ELSE s END AS sig FROM s WINDOW w AS (PARTITION BY k ORDER BY t)""")
def repeat_suppress(spark, sf_dir):
    return _side(spark, sf_dir).select("k", "t", wn.repeat_suppressed(F.col("s"), ["k"], "t", 3).alias("sig"))


@query(f"""WITH {BARS}, {SIDE}, a AS (SELECT k, t, list(s) OVER {rn(6)} AS a FROM s)
  SELECT k, t, list_sort(list_transform(list_distinct(a), lambda v: {{'c': -len(list_filter(a, lambda u: u = v)), 'p': list_position(a, v), 'v': v}}))[1].v AS mode FROM a""")
def rolling_mode(spark, sf_dir):
    return wn.rolling_mode(_side(spark, sf_dir), ["k"], "t", "s", 6, "mode").select("k", "t", "mode")


@query(f"""WITH {BARS}, {SIDE}, c AS (SELECT *, i - row_number() OVER (PARTITION BY k, s ORDER BY t) AS g FROM s) SELECT k, max(n) FILTER (s = 1)::BIGINT AS longest FROM (SELECT k, s, g, count(*) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1""")
def longest_run(spark, sf_dir):
    return islands.longest_run(_side(spark, sf_dir), ["k"], "t", F.col("s") == 1, "longest")


@query(f"""WITH {BARS}, {SIDE}, c AS (SELECT *, i - row_number() OVER (PARTITION BY k, s ORDER BY t) AS g FROM s), q AS (SELECT k, s, min(t) AS seg_start, max(t) AS seg_end, count(*)::BIGINT AS n_rows FROM c GROUP BY k, s, g)
  SELECT *, lead(seg_start) OVER (PARTITION BY k ORDER BY seg_start) AS next_start FROM q""")
def state_segments(spark, sf_dir):
    return islands.segments(_side(spark, sf_dir), ["k"], "t", "s")


@query(f"""WITH {BARS}, {SIDE} SELECT k, t, coalesce(min(s) OVER f <> s OR max(s) OVER f <> s, false) AS leaves FROM s WINDOW f AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def state_exit(spark, sf_dir):
    return _side(spark, sf_dir).select("k", "t", islands.state_exit("s", ["k"], "t", 4).alias("leaves"))


@query(f"""WITH {BARS}, {SIDE}, b AS (SELECT k, (i - 1) // 12 AS b, s, count(*) AS n, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1, 2, 3), m AS (SELECT k, b, arg_min(s, (-n, s)) AS mode, min(lo) AS lo, max(hi) AS hi, sum(n) AS n FROM b GROUP BY 1, 2),
  g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b) - row_number() OVER (PARTITION BY k, mode ORDER BY b) AS g FROM m) SELECT k, mode, min(lo) AS seg_start, max(hi) AS seg_end, sum(n)::BIGINT AS n_rows FROM g GROUP BY k, mode, g""")
def modal_segments(spark, sf_dir):
    return islands.modal_segments(_side(spark, sf_dir), ["k"], "t", "s", 12)


@query(f"""WITH {BARS}, g AS (SELECT k, t, CASE WHEN n > 1 THEN close END AS v, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars),
  f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, last_value(v IGNORE NULLS) OVER p AS va, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ib, first_value(v IGNORE NULLS) OVER q AS vb FROM g
    WINDOW p AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT k, t, round(coalesce(v, va + (vb - va) * (i - ia) / nullif(ib - ia, 0), va), 6) + 0.0 AS filled FROM f""")
def interpolate_nulls(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("v", F.when(F.col("n") > 1, F.col("close")))
    return rounded(wn.interpolated(b, ["k"], "t", "v", "filled").select("k", "t", "filled"))


RET = """ret AS (SELECT k, t, high, low, close, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN 1e4 * ln(close / lag(close) OVER w) END AS ret FROM bars WINDOW w AS (PARTITION BY k ORDER BY t))"""


def _ret(spark, sf_dir, ln=F.ln):
    return tw.base_returns(bars(spark, sf_dir), ["k"], "t", "close", ln=ln)


@query(f"""WITH {BARS}, {RET}, b AS (SELECT k, t, CASE WHEN count(ret) OVER {rn(4)} >= 4 THEN sum(ret) OVER {rn(4)} END AS b FROM ret),
  l AS (SELECT k, t, b AS b0, lag(b, 4) OVER w AS b1, lag(b, 8) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY k ORDER BY t))
  SELECT k, t, round(CASE WHEN b0 + b1 + b2 IS NOT NULL THEN ((sign(b0) = sign(b0 + b1 + b2))::INT + (sign(b1) = sign(b0 + b1 + b2))::INT + (sign(b2) = sign(b0 + b1 + b2))::INT) / 3.0 END, 6) + 0.0 AS agree FROM l""")
def block_alignment(spark, sf_dir):
    return rounded(wn.block_alignment(_ret(spark, sf_dir, c_ln), ["k"], "t", "ret", 4, 3, "agree").select("k", "t", "agree"))


@query(f"""WITH {BARS} SELECT k, t, round(coalesce(sum(n) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY k), 6) + 0.0 AS share FROM bars""")
def running_share(spark, sf_dir):
    return rounded(wn.running_share(bars(spark, sf_dir), ["k"], "t", "n", "share").select("k", "t", "share"))


@query(f"""WITH {BARS} SELECT k, t, {r("s", "m")}, c FROM (SELECT k, t, sum(close) OVER {tn(6 * HOUR)} AS s, max(close) OVER {tn(6 * HOUR)} AS m, count(*) OVER {tn(6 * HOUR)} AS c FROM bars)""")
def rolling_time_range(spark, sf_dir):
    w = span(["k"], "t", 6 * HOUR)
    return rounded(bars(spark, sf_dir).select("k", "t", F.sum("close").over(w).alias("s"), F.max("close").over(w).alias("m"), F.count("*").over(w).alias("c")))


@query(f"""WITH {BARS}, {RET} SELECT k, t, {r("rv", "width")} FROM (SELECT k, t, sqrt(sum(ret * ret) OVER {tn(DAY)}) / sqrt(24) AS rv, 1e4 * ln(max(high) OVER {tn(DAY)} / min(low) OVER {tn(DAY)}) AS width FROM ret WHERE low > 0)""")
def realised_volatility(spark, sf_dir):
    d = _ret(spark, sf_dir).where("low > 0")
    return rounded(d.select("k", "t", tw.realised_volatility(F.col("ret"), ["k"], "t", DAY, True).alias("rv"), tw.range_width("high", "low", ["k"], "t", DAY).alias("width")))


@query(f"""WITH {BARS}, p AS (SELECT k, t, ln(close) AS y, epoch_us(t) / 3600000000.0 AS x FROM bars WHERE close > 0)
  SELECT k, t, {r("tr_slope", "tr_r2")} FROM (SELECT k, t, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(y, x - 473352) OVER w END AS tr_slope, CASE WHEN count(*) OVER w >= 3 THEN coalesce(regr_r2(y, x - 473352) OVER w, 0) END AS tr_r2 FROM p WINDOW w AS {tn(DAY)})""")
def rolling_trend(spark, sf_dir):
    return rounded(tw.rolling_trend(bars(spark, sf_dir).where("close > 0"), ["k"], "t", "close", DAY, "tr").select("k", "t", "tr_slope", "tr_r2"))


@query(f"""WITH {BARS}, {RET}, s AS (SELECT k, t, sum((ret > 0)::INT) OVER w AS up, sum((ret < 0)::INT) OVER w AS down, count(ret) OVER w AS n, sum(ret) OVER w AS total FROM ret WINDOW w AS {tn(DAY)})
  SELECT k, t, round(CASE WHEN total IS NOT NULL THEN CASE WHEN total > 0 THEN up WHEN total < 0 THEN down ELSE 0 END / n END, 6) + 0.0 AS aligned FROM s""")
def direction_alignment(spark, sf_dir):
    return rounded(_ret(spark, sf_dir, c_ln).select("k", "t", tw.direction_alignment("ret", ["k"], "t", DAY).alias("aligned")))


@query(f"""WITH {BARS}, {RET}, v AS (SELECT k, t, sqrt(sum(ret * ret) OVER {tn(3 * HOUR)}) AS rv FROM ret) SELECT k, t, round(CASE WHEN count(rv) OVER {tn(DAY)} >= 4 THEN stddev_pop(rv) OVER {tn(DAY)} / nullif(avg(rv) OVER {tn(DAY)}, 0) END, 6) + 0.0 AS vov FROM v""")
def vol_of_vol(spark, sf_dir):
    d = _ret(spark, sf_dir)
    d = d.withColumn("rv", tw.realised_volatility(F.col("ret"), ["k"], "t", 3 * HOUR))
    return rounded(d.select("k", "t", tw.vol_of_vol("rv", ["k"], "t", DAY, 4).alias("vov")))


@query(f"""WITH {BARS}, {RET}, g AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS sg, abs(ret * lag(ret) OVER (PARTITION BY k ORDER BY t)) AS bv FROM ret), z AS (SELECT *, abs(ret) / nullif(sg, 0) AS z FROM g),
  a AS (SELECT k, t, max(z) OVER w AS mz, sum(CASE WHEN z > 2 THEN 1 ELSE 0 END) OVER w AS c, sum(ret * ret) OVER w AS rv, pi() / 2 * sum(bv) OVER w AS bvs FROM z WINDOW w AS {tn(DAY)})
  SELECT k, t, round(mz, 6) + 0.0 AS jump_max_z, c::BIGINT AS jump_count, round(CASE WHEN (rv - bvs) / nullif(rv, 0) IS NOT NULL THEN least(greatest((rv - bvs) / nullif(rv, 0), 0), 1) END, 6) + 0.0 AS jump_ratio,
    round(0.5 * (1 - exp(-mz / 2)) + 0.3 * coalesce(CASE WHEN (rv - bvs) / nullif(rv, 0) IS NOT NULL THEN least(greatest((rv - bvs) / nullif(rv, 0), 0), 1) END, 0) + 0.2 * (1 - exp(-c / 2)), 6) + 0.0 AS jump_proxy FROM a""")
def jump_features(spark, sf_dir):
    d = _ret(spark, sf_dir).withColumn("sg", F.stddev_samp("ret").over(rows(["k"], "t", 48, end=-1)))
    return rounded(tw.jump_features(d, ["k"], "t", "ret", "sg", DAY, 2.0, "jump").select("k", "t", "jump_max_z", "jump_count", "jump_ratio", "jump_proxy"))


@query(f"""WITH {BARS}, {RET} SELECT k, t, round(arg_max(ret, (abs(ret), -epoch_us(t))) OVER {tn(DAY)}, 6) + 0.0 AS big FROM ret""")
def signed_max_abs(spark, sf_dir):
    return rounded(_ret(spark, sf_dir).select("k", "t", tw.signed_max_abs("ret", ["k"], "t", DAY).alias("big")))


@query(f"""WITH {BARS}, o AS (SELECT k, t, count(close) OVER {tn(DAY)} AS o FROM bars) SELECT k, t, o AS q_obs, round(least(greatest(1 - o / 24.0, 0), 1), 6) + 0.0 AS q_missing, (o < 24)::INT AS q_gap, (o >= 19.2)::INT AS q_valid FROM o""")
def data_quality_windows(spark, sf_dir):
    return rounded(tw.data_quality(bars(spark, sf_dir), ["k"], "t", "close", DAY, HOUR, "q").select("k", "t", "q_obs", "q_missing", "q_gap", "q_valid"))


@query(f"""WITH {BARS}, a AS (SELECT k, t, close, list(close) OVER {tn(2 * DAY)} AS a FROM bars)
  SELECT k, t, round(CASE WHEN len(a) >= 20 THEN (len(list_filter(a, lambda v: v < close)) + (len(list_filter(a, lambda v: v = close)) - 1) / 2) / nullif(len(a) - 1, 0) END, 6) + 0.0 AS pr FROM a""")
def past_percentile(spark, sf_dir):
    return rounded(tw.past_percentile(bars(spark, sf_dir), ["k"], "t", "close", 2 * DAY, 20, "pr").select("k", "t", "pr"))


@query(f"""WITH {BARS}, a AS (SELECT k, t, close, coalesce(list(close) OVER (PARTITION BY k ORDER BY epoch_us(t) RANGE BETWEEN {2 * DAY} PRECEDING AND 1 PRECEDING), []) AS a FROM bars)
  SELECT k, t, round(CASE WHEN len(a) >= 10 THEN (len(list_filter(a, lambda v: v < close)) + len(list_filter(a, lambda v: v <= close))) / (2.0 * len(a)) END, 6) + 0.0 AS mr FROM a""")
def past_midrank(spark, sf_dir):
    return rounded(tw.past_midrank(bars(spark, sf_dir), ["k"], "t", "close", 2 * DAY, 10, "mr").select("k", "t", "mr"))


@query(f"""WITH {BARS}, p AS (SELECT *, lag(close) OVER (PARTITION BY k ORDER BY t) AS p FROM bars), q AS (SELECT k, t, close, CASE WHEN count(p) OVER {tn(3 * DAY)} >= 12 THEN quantile_cont(p, [0.25, 0.5, 0.75]) OVER {tn(3 * DAY)} END AS q FROM p), z AS (SELECT k, t, (close - q[2]) / nullif((q[3] - q[1]) / 1.349, 0) AS z FROM q)
  SELECT k, t, round(CASE WHEN z IS NOT NULL THEN least(greatest(z, -5), 5) END, 6) + 0.0 AS z FROM z""")
def iqr_z(spark, sf_dir):
    return rounded(tw.iqr_z(bars(spark, sf_dir), ["k"], "t", "close", 3 * DAY, 12, "z").select("k", "t", "z"))


@query(f"""WITH {FLOWS}, q AS (SELECT *, quantile_cont(fl, 0.25) OVER w AS q1, quantile_cont(fl, 0.75) OVER w AS q3, max(fl) OVER w AS m FROM flows WINDOW w AS {tn(7 * DAY)})
  SELECT t, round(CASE WHEN fl > q3 + 1.5 * (q3 - q1) THEN coalesce(q3 + 2.5 * (q3 - q1) * (fl - q3) / nullif(m - q3, 0), q3 + 1.5 * (q3 - q1)) ELSE fl END, 6) + 0.0 AS capped FROM q""")
def outlier_cap(spark, sf_dir):
    return rounded(tw.outlier_cap(flows(spark, sf_dir), ["k"], "t", "fl", 7 * DAY, "capped", k=1.5).select("t", "capped"))


PC = f"""WITH {BARS}, {RET}, a AS (SELECT k, t, ret, sqrt(sum(ret * ret) OVER w) AS rv24, abs(sum(ret) OVER w) / nullif(sum(abs(ret)) OVER w, 0) AS tr_eff, count(close) OVER w AS q_obs,
   CASE WHEN count(*) FILTER (close > 0) OVER w >= 3 THEN regr_slope(CASE WHEN close > 0 THEN ln(close) END, CASE WHEN close > 0 THEN epoch_us(t) / 3600000000.0 - 473352 END) OVER w END AS tr_slope FROM ret WINDOW w AS {tn(DAY)}),
  l AS (SELECT *, list(rv24) OVER {tn(7 * DAY)} AS a FROM a)"""


@query(PC + f""" SELECT k, t, {r("ret", "rv24", "tr_eff", "tr_slope")}, q_obs, round(CASE WHEN len(list_filter(a, lambda v: v IS NOT NULL)) >= 20 AND rv24 IS NOT NULL THEN (len(list_filter(a, lambda v: v < rv24)) + (len(list_filter(a, lambda v: v = rv24)) - 1) / 2) / nullif(len(list_filter(a, lambda v: v IS NOT NULL)) - 1, 0) END, 6) + 0.0 AS rv_rank FROM l""")
def price_context(spark, sf_dir):
    """Returns, realised volatility, trend, quality and the past rank of volatility of hourly bars."""
    d = _ret(spark, sf_dir)
    d = d.withColumn("rv24", tw.realised_volatility(F.col("ret"), ["k"], "t", DAY))
    d = tw.rolling_trend(d, ["k"], "t", "close", DAY, "tr")
    d = tw.trend_composite(d, ["k"], "t", "ret", DAY, "tr")
    d = tw.data_quality(d, ["k"], "t", "close", DAY, HOUR, "q")
    d = tw.past_percentile(d, ["k"], "t", "rv24", 7 * DAY, 20, "rv_rank")
    return rounded(d.select("k", "t", "ret", "rv24", "tr_eff", "tr_slope", "q_obs", "rv_rank"))
