"""Queries: reviews of features and predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, span
from chronoloom.operators import joins, reports as rp, resample, reviews as rv
from chronoloom.plans.registry import BARS, FLOWS, bars, flows, query, r, rounded, table

PRED = """p AS (SELECT o_orderpriority, o_orderdate, o_orderkey, o_totalprice - 100000 AS y, CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 997) * 150.0 END AS p FROM orders)"""


def _predictions(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderpriority", "o_orderdate", "o_orderkey", (F.col("o_totalprice") - 100000).alias("y"), F.when(k % 13 > 0, (k % 997) * 150.0).alias("p"))


@query(f"""WITH {PRED} SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(greatest(0.65 * (y - p), -0.35 * (y - p))), 4) + 0.0 AS pinball, round(avg(abs(y - p)), 4) + 0.0 AS mae, round(avg(y), 4) + 0.0 AS mean_actual,
  round(quantile_cont(y, 0.5), 4) + 0.0 AS median_actual, round(avg(p), 4) + 0.0 AS mean_predicted, round(avg((y > 0)::INT), 4) + 0.0 AS hit_rate FROM p WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1""")
def prediction_metrics(spark, sf_dir):
    return rounded(rv.prediction_metrics(_predictions(spark, sf_dir), ["o_orderpriority"], "y", "p", 0.65), 4)


_CALIB = "avg((y <= 150000)::INT) - 0.65 AS coverage_error, 100 * (1 - avg(greatest(0.65 * (y - 50000), -0.35 * (y - 50000))) / avg(greatest(0.65 * (y - 51000), -0.35 * (y - 51000)))) AS improvement"


@query(f"""WITH {PRED}, o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM p),
  s AS (SELECT *, CASE WHEN rn <= floor(n * 0.70) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM o),
  c AS (SELECT split, o_orderpriority, {_CALIB} FROM s GROUP BY 1, 2), l AS (SELECT o_orderpriority, {_CALIB} FROM s WHERE epoch_us(o_orderdate) >= (SELECT max(epoch_us(o_orderdate)) FROM s) - 30 * 86400000000 GROUP BY 1),
  a AS (SELECT max(abs(coverage_error)) AS worst_error, min(improvement) AS least_gain FROM c WHERE split = 'test'), b AS (SELECT max(abs(coverage_error)) AS recent_error, min(improvement) AS recent_gain FROM l)
  SELECT {r("worst_error", "least_gain", "recent_error", "recent_gain")}, CASE WHEN greatest(worst_error, recent_error) > 0.08 OR least(least_gain, recent_gain) < -1 THEN 'retrain_now' WHEN greatest(worst_error, recent_error) > 0.05 OR least(least_gain, recent_gain) < 0.5 THEN 'watch' ELSE 'ok' END AS status FROM a, b""")
def monitoring_rerun(spark, sf_dir):
    """The monitor of saved predictions: calibration by split, that of the last 30 days, the state."""
    s = resample.chronological_split(_predictions(spark, sf_dir), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 0.70, 0.15)
    loss = lambda at: F.avg(rv.pinball("y", at, 0.65))
    calibration = [(F.avg((F.col("y") <= 150000).cast("double")) - 0.65).alias("coverage_error"), (100 * (1 - loss(50000.0) / loss(51000.0))).alias("improvement")]
    recent = rp.trailing(s, "o_orderdate", 30 * DAY).groupBy("o_orderpriority").agg(*calibration)
    return rounded(rv.retrain_status(s.groupBy("split", "o_orderpriority").agg(*calibration), recent))


@query("""WITH x AS (SELECT CASE WHEN event_id % 3 > 0 THEN value / 50 END AS data_quality, value - 20 AS response_score, (event_id % 7)::DOUBLE AS n_count, value AS level, event_type FROM events)
  SELECT 'data_quality' AS "column", TRUE AS exists, round(avg((data_quality IS NULL)::INT), 6) + 0.0 AS missing_rate, round(avg(coalesce((data_quality < 0 OR data_quality > 1)::INT, 0)), 6) + 0.0 AS outlier_rate, '[0, 1]' AS expected_range FROM x
  UNION ALL SELECT 'response_score', TRUE, 0.0, round(avg((response_score < 0 OR response_score > 100)::INT), 6) + 0.0, '[0, 100]' FROM x UNION ALL SELECT 'n_count', TRUE, 0.0, 0.0, '>=0' UNION ALL SELECT 'level', TRUE, 0.0, 0.0, 'finite'
  UNION ALL SELECT 'event_type', TRUE, 0.0, NULL, 'categorical' UNION ALL SELECT 'absent', FALSE, 1.0, NULL, 'missing'""")
def input_quality(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.when(i % 3 > 0, v / 50).alias("data_quality"), (v - 20).alias("response_score"), (i % 7).cast("double").alias("n_count"), v.alias("level"), "event_type")
    return rounded(rv.input_quality(x, ["data_quality", "response_score", "n_count", "level", "event_type", "absent"]))


def _stats_sql(c: str, frm: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg(({c} IS NULL)::INT), 4) + 0.0 AS missing_rate, round(avg(coalesce(({c} < p25 - 3 * (p75 - p25) OR {c} > p75 + 3 * (p75 - p25))::INT, 0)), 4) + 0.0 AS outlier_rate, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std,
      min({c})::DOUBLE AS v_min, max({c})::DOUBLE AS v_max, round(any_value(p25), 4) + 0.0 AS p25, round(any_value(p50), 4) + 0.0 AS p50, round(any_value(p75), 4) + 0.0 AS p75
      FROM {frm}, (SELECT quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM {frm})"""


@query(f"""WITH x AS (SELECT CASE WHEN event_id % 4 > 0 THEN value END AS a, CASE WHEN event_id % 50 = 0 THEN 1000.0 ELSE (event_id % 20)::DOUBLE END AS b FROM events) SELECT "column", missing_rate, outlier_rate, mean, std, {r("v_min", "v_max", digits=4)}, p25, p50, p75 FROM ({_stats_sql("a", "x")} UNION ALL {_stats_sql("b", "x")})""")
def input_statistics(spark, sf_dir):
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.when(i % 4 > 0, F.col("value")).alias("a"), F.when(i % 50 == 0, 1000.0).otherwise((i % 20).cast("double")).alias("b"))
    return rounded(rv.input_statistics(x, ["a", "b"]), 4)


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events), c AS (SELECT least(floor((value - lo) / (hi - lo) * 140), 139)::BIGINT AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1),
  g AS (SELECT bin, lo + (bin + 0.5) * (hi - lo) / 140 AS centre, coalesce(c.n, 0) / (e.n * ((hi - lo) / 140)) AS density FROM range(140) t(bin) CROSS JOIN e LEFT JOIN c USING (bin))
  SELECT bin, round(centre, 6) + 0.0 AS centre, round(density, 8) + 0.0 AS density, round((""" + " + ".join(f"{k} * lag(density, {i - 3}, 0) OVER (ORDER BY bin)" for i, k in enumerate(rv.KERNEL)) + ") / 16, 8) + 0.0 AS smooth FROM g")
def smoothed_density(spark, sf_dir):
    d = rv.smoothed_density(table(spark, sf_dir, "events"), "value")
    return d.select("bin", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("centre", 6), ("density", 8), ("smooth", 8))])


@query(f"""WITH RECURSIVE {FLOWS}, s AS (SELECT 'fl' AS side, t, fl AS x FROM flows UNION ALL SELECT 'fs', t, fs FROM flows), q AS (SELECT side, quantile_cont(x, 0.99) AS q FROM s GROUP BY 1), h AS (SELECT side, t, x >= q AS h, row_number() OVER (PARTITION BY side ORDER BY t) AS i FROM s JOIN q USING (side)),
  e(side, i, t, sel, since) AS (SELECT side, i, t, h, CASE WHEN h THEN 1 ELSE 14 END FROM h WHERE i = 1 UNION ALL SELECT h.side, h.i, h.t, h.h AND e.since > 12, CASE WHEN h.h AND e.since > 12 THEN 1 ELSE e.since + 1 END FROM e JOIN h ON h.side = e.side AND h.i = e.i + 1),
  p AS (SELECT t, CASE WHEN price > 0 THEN ln(price) END AS l, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS m FROM flows), y AS (SELECT i, m, t, coalesce(l - lag(l) OVER (ORDER BY t), 0) AS step FROM p), z AS (SELECT i, m, t, sum(step) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS way FROM y),
  v AS (SELECT e.side, o.off, b.way - a.way AS ret FROM e JOIN z ON z.t = e.t AND z.i > 12 AND z.i + 24 <= z.m CROSS JOIN range(-12, 25) o(off) JOIN z a ON a.i = z.i - 12 JOIN z b ON b.i = z.i + o.off WHERE e.sel)
  SELECT side, off::INT AS "offset", round(quantile_cont(ret, 0.5), 6) + 0.0 AS median, count(*)::BIGINT AS n FROM v GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    return rounded(rv.event_windows(flows(spark, sf_dir), ["k"], "t", "price", ["fl", "fs"]).select("side", "offset", "median", "n"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events GROUP BY 1) SELECT event_type, round(a - 0.08 * (b - a), 6) + 0.0 AS axis_low, round(b + 0.08 * (b - a), 6) + 0.0 AS axis_high FROM q""")
def axis_bounds(spark, sf_dir):
    return rounded(rv.axis_bounds(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("""WITH x AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 200 = 0 THEN value * 40 ELSE value END AS v FROM events), s AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS d FROM x GROUP BY 1), z AS (SELECT event_id, event_type, ts, abs(v - m) / d AS z FROM x JOIN s USING (event_type))
  SELECT event_id, event_type, round(z, 6) + 0.0 AS z FROM z WHERE z > 5 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY z DESC, ts) <= 20""")
def outlier_markers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 200 == 0, F.col("value") * 40).otherwise(F.col("value")))
    return rounded(rv.outlier_markers(e, ["event_type"], "ts", "v", most=20).select("event_id", "event_type", "z"))


@query(f"""WITH {BARS}, a AS (SELECT k, t, close, avg(close) OVER (PARTITION BY k ORDER BY epoch_us(t) RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS m FROM bars) SELECT k, t, {r("close", "m")} FROM a""")
def incremental_features(spark, sf_dir):
    """A day's mean, built for the bars of an old table and continued from where that ends."""
    build = lambda df: df.withColumn("m", F.avg("close").over(span(["k"], "t", DAY)))
    b = bars(spark, sf_dir).select("k", "t", "close")
    cache = build(b.where(F.col("t") < F.lit("2024-01-20")))
    return rounded(rv.incremental(b, cache, build, "t", DAY))


@query(f"""WITH {BARS}, f AS (SELECT k, t, close, n FROM bars WHERE n > 1), j AS (SELECT bars.k, bars.t, f.n FROM bars LEFT JOIN f ON f.k = bars.k AND f.t = bars.t AND f.close = bars.close)
  SELECT 'k' AS "column", 0.0 AS null_percent UNION ALL SELECT 'n', round(100 * avg((n IS NULL)::INT), 6) + 0.0 FROM j""")
def export_null_percent(spark, sf_dir):
    """NULLs of an export that joins features to all bars by time and price."""
    b = bars(spark, sf_dir)
    joined = joins.time_join([b.select("k", "t", "close"), b.where("n > 1").select("k", "t", "close", "n")], ["k", "t", "close"], "left")
    return rounded(rv.null_percent(joined, ["k", "n"]))


@query("""SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","absent":null}' AS payload FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""")
def latest_payload(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("absent", F.lit(None).cast("string"))
    return rv.latest_payload(e, ["ts", "event_id"], ["event_id", "user_id", "event_type", "absent"])


_DOCUMENTED = [("close", "price", "last price of the bar"), ("rv_24h", "volatility", "realised volatility of a day"), ("total", "size", "sum of the bar's values")]
_BAR_COLUMNS = ("k", "t", "open", "high", "low", "close", "total", "n", "wide")


@query(f"""WITH {BARS}, b AS (SELECT *, CASE WHEN n > 1 THEN high - low END AS wide FROM bars), c(name, category, description, documented, actual) AS (VALUES ('close', 'price', 'last price of the bar', TRUE, TRUE), ('rv_24h', 'volatility', 'realised volatility of a day', TRUE, FALSE), ('total', 'size', 'sum of the bar''s values', TRUE, TRUE),
  {", ".join(f"('{c}', '{k}', 'not documented', FALSE, TRUE)" for c, k in (("k", "other"), ("t", "other"), ("open", "price"), ("high", "price"), ("low", "price"), ("n", "other"), ("wide", "other")))}),
  m AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, round(100 * avg(({c} IS NULL)::INT), 6) + 0.0 AS null_percent FROM b" for c in _BAR_COLUMNS)})
  SELECT name, category, description, documented, actual, null_percent FROM c LEFT JOIN m USING (name)""")
def feature_catalogue(spark, sf_dir):
    """What is documented and what the bars' frame has, with the share of NULLs measured on it."""
    b = bars(spark, sf_dir).withColumn("wide", F.when(F.col("n") > 1, F.col("high") - F.col("low")))
    found = rv.catalogue(spark, _DOCUMENTED, b.columns, {"open": "price", "high": "price", "low": "price"})
    measured = rv.null_percent(b, b.columns).withColumnRenamed("column", "name")
    return rounded(found.join(measured, "name", "left"))


@query(f"""WITH {FLOWS} SELECT t, round(greatest(2 + 0.5 * fl - 0.25 * fs, 0), 6) + 0.0 AS size, round(greatest(2 + 0.5 * fl - 0.25 * fs, 0) * least(price / 100, 1) * sign(fl - fs), 6) + 0.0 AS expectation FROM flows""")
def batch_inference(spark, sf_dir):
    f = flows(spark, sf_dir).withColumns({"rel": F.least(F.col("price") / 100, F.lit(1.0)), "d": F.signum(F.col("fl") - F.col("fs"))})
    return rounded(rv.scored(f, {"fl": 0.5, "fs": -0.25}, 2.0, "rel", "d").select("t", "size", "expectation"))


def _thinned(where: str, columns: str) -> str:
    """SQL: bars that meet a condition, thinned evenly to 50 of each key."""
    return f"""WITH {BARS}, i AS (SELECT k, t, close, total, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM bars WHERE {where}), p AS (SELECT DISTINCT k, floor(j * (n - 1) / 49 + 1e-9)::BIGINT AS i FROM (SELECT DISTINCT k, n FROM i), (SELECT unnest(range(50)) AS j) WHERE n > 50)
  SELECT {columns} FROM i LEFT JOIN p ON p.k = i.k AND p.i = i.i WHERE n <= 50 OR p.i IS NOT NULL"""


@query(_thinned("n > 1", "i.k, i.t, round(close, 6) + 0.0 AS close, round(total, 6) + 0.0 AS total"))
def paired_sample(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("total", F.when(F.col("n") > 1, F.col("total")).otherwise(float("nan")))
    return rounded(rv.paired_sample(b, ["k"], "t", "close", "total", 50))


@query(_thinned("n < 2", "i.k, i.t"))
def missing_markers(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("close", F.when(F.col("n") > 1, F.col("close")))
    return rv.missing_markers(b, ["k"], "t", "close", 50)
