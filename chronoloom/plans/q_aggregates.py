"""Queries: aggregation, evaluation, selection, checks and scalar formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import ordered
from chronoloom.operators import aggregates as ag, checks, resample, selection, windows as wn
from chronoloom.operators import ranks
from chronoloom.plans.registry import BARS, FLOWS, bars, flows, query, r, rounded, table


@query(f"""WITH b AS (SELECT floor(l_quantity / 10)::BIGINT AS lv, l_extendedprice AS x FROM lineitem), g AS (SELECT lv, count(*)::BIGINT AS n, min(x) AS v_min, max(x) AS v_max, quantile_cont(x, 0.5) AS v_median, avg(x) AS v_mean, stddev_samp(x) AS v_std FROM b GROUP BY 1)
  SELECT lv, n, {r("v_min", "v_max", "v_median", "v_mean", "v_std")}, round(n / sum(n) OVER (), 6) + 0.0 AS share, round(sum(n) OVER (ORDER BY lv) / sum(n) OVER (), 6) + 0.0 AS share_low, round(v_max - v_min, 6) + 0.0 AS v_range, round((sum(n) OVER (ORDER BY lv) - n) / sum(n) OVER (), 6) + 0.0 AS share_below FROM g""")
def bin_stats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("lv"), F.col("l_extendedprice").alias("x"))
    return rounded(ag.bin_statistics(l, "lv", "x"))


@query("""SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1""")
def state_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.9).alias("p90"), F.avg("value").alias("mean")))


@query("""SELECT v AS event_type, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) + 0.0 AS share FROM (VALUES ('click'), ('view'), ('refund')) d(v) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = v""")
def fixed_domain(spark, sf_dir):
    return rounded(ag.fixed_domain(table(spark, sf_dir, "events"), "event_type", ["click", "view", "refund"]))


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) + 0.0 AS share FROM lineitem GROUP BY 1, 2""")
def share_in_group(spark, sf_dir):
    return rounded(ag.share_within(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  s AS (SELECT *, CASE WHEN rn <= floor(n * 0.70) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM o)
  SELECT coalesce(split, 'all') AS split, o_orderpriority, count(*)::BIGINT AS n, round(avg((o_totalprice <= 250000)::INT), 6) + 0.0 AS coverage, round(avg(greatest(0.65 * (o_totalprice - 250000), -0.35 * (o_totalprice - 250000))), 6) + 0.0 AS loss FROM s GROUP BY GROUPING SETS ((split, o_orderpriority), (o_orderpriority))""")
def coverage_by_split_and_all(spark, sf_dir):
    s = resample.chronological_split(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 0.70, 0.15)
    hit, loss = F.avg((F.col("o_totalprice") <= 250000).cast("double")), F.avg(sc.pinball("o_totalprice", 250000.0, 0.65))
    return rounded(ag.with_total(s, "split", ["o_orderpriority"], [F.count("*").alias("n"), hit.alias("coverage"), loss.alias("loss")]))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.8) AS q80, quantile_cont(o_totalprice, 0.9) AS q90 FROM orders), m AS (SELECT unnest(list_filter([CASE WHEN o_totalprice >= q80 THEN 'top20' END, CASE WHEN o_totalprice >= q90 THEN 'top10' END, 'all'], lambda x: x IS NOT NULL)) AS subset, o_totalprice FROM orders, q)
  SELECT subset, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) + 0.0 AS mean FROM m GROUP BY 1""")
def conditional_subsets(spark, sf_dir):
    from chronoloom.operators.joins import with_thresholds

    o = table(spark, sf_dir, "orders").select("o_totalprice")
    o = with_thresholds(o, o.agg(F.percentile("o_totalprice", 0.8).alias("q80"), F.percentile("o_totalprice", 0.9).alias("q90")))
    names = F.array_compact(F.array(F.when(F.col("o_totalprice") >= F.col("q80"), "top20"), F.when(F.col("o_totalprice") >= F.col("q90"), "top10"), F.lit("all")))
    return rounded(o.select(F.explode(names).alias("subset"), "o_totalprice").groupBy("subset").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")))


TR = """tr AS (SELECT user_id, event_id, value, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'NA') || '->' || event_type AS move FROM events)"""


def _moves(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", F.lag("event_type").over(w).alias("before"), sc.transition(F.lag("event_type").over(w), F.col("event_type")).alias("move"))


@query(f"""WITH {TR}, top AS (SELECT move FROM tr GROUP BY 1 ORDER BY count(*) DESC, move LIMIT 10) SELECT move, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean FROM tr SEMI JOIN top USING (move) GROUP BY 1""")
def top_transitions(spark, sf_dir):
    m = _moves(spark, sf_dir)
    top = m.groupBy("move").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "move").limit(10)
    return rounded(m.join(F.broadcast(top), "move", "left_semi").groupBy("move").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("""WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type FROM events), c AS (SELECT before, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error FROM t WHERE before IS NOT NULL GROUP BY 1)
  SELECT before, """ + ", ".join(f'round("{c}" / (click + "view" + purchase + signup + error), 6) + 0.0 AS "{c}"' for c in ("click", "view", "purchase", "signup", "error")) + " FROM c")
def transition_matrix(spark, sf_dir):
    m = _moves(spark, sf_dir).where("before IS NOT NULL")
    return rounded(ag.crosstab_share(m, "before", "event_type", ["click", "view", "purchase", "signup", "error"]))


DEC = """d AS (SELECT event_type, value, event_id, greatest(0, ceil((row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) * 10.0 / (count(*) OVER (PARTITION BY event_type) - 1) - 1e-12) - 1)::INT AS decile FROM events)"""


@query(f"""WITH {DEC} SELECT event_type, decile, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean FROM d GROUP BY 1, 2""")
def decile_metrics(spark, sf_dir):
    d = ag.quantile_bucket(table(spark, sf_dir, "events"), ["event_type"], ["value", "event_id"], 10, "decile")
    return rounded(d.groupBy("event_type", "decile").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(f"""WITH {DEC}, m AS (SELECT event_type, decile, avg(event_id % 100) AS y FROM d GROUP BY 1, 2), k AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY decile) AS a, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS b FROM m)
  SELECT event_type, round(corr(a, b), 6) + 0.0 AS rho, count(*)::BIGINT AS n, coalesce(corr(a, b) >= 0.95 AND count(*) >= 5, false) AS passed FROM k GROUP BY 1""")
def decile_monotonicity(spark, sf_dir):
    d = ag.quantile_bucket(table(spark, sf_dir, "events"), ["event_type"], ["value", "event_id"], 10, "decile")
    m = d.groupBy("event_type", "decile").agg(F.avg(F.col("event_id") % 100).alias("y"))
    out = ag.spearman(m, ["event_type"], "decile", "y")
    return rounded(out.withColumn("passed", F.coalesce((F.col("rho") >= 0.95) & (F.col("n") >= 5), F.lit(False))))


@query("""WITH k AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS b FROM customer)
  SELECT c_mktsegment, round(corr(a, b), 6) + 0.0 AS rho, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def spearman_by_segment(spark, sf_dir):
    return rounded(ag.spearman(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey"))


@query("""SELECT days, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS median FROM events, (VALUES (1), (3), (7), (14)) d(days), (SELECT max(ts) AS latest FROM events) WHERE epoch_us(latest) - epoch_us(ts) <= days * 86400000000 GROUP BY 1""")
def trailing_monitor(spark, sf_dir):
    return rounded(ag.trailing_monitor(table(spark, sf_dir, "events"), "ts", [1, 3, 7, 14], [F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median")]))


@query("""WITH w AS (SELECT days, event_type, avg((value <= 100)::INT) - 0.65 AS err FROM events, (VALUES (7), (14)) d(days), (SELECT max(ts) AS latest FROM events) WHERE epoch_us(latest) - epoch_us(ts) <= days * 86400000000 GROUP BY 1, 2)
  SELECT days, round(max(abs(err)), 6) + 0.0 AS worst, CASE WHEN max(abs(err)) > 0.10 THEN 'retrain_now' WHEN max(abs(err)) > 0.05 THEN 'watch' ELSE 'ok' END AS status FROM w GROUP BY 1""")
def retrain_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = ag.trailing_monitor(e, "ts", [7, 14], [F.avg(F.when(F.col("event_type") == k, (F.col("value") <= 100).cast("double"))).alias(k) for k in ("click", "view", "purchase", "signup", "error")])
    worst = F.greatest(*[F.abs(F.col(k) - 0.65) for k in ("click", "view", "purchase", "signup", "error")])
    return rounded(parts.select("days", worst.alias("worst"), F.when(worst > 0.10, "retrain_now").when(worst > 0.05, "watch").otherwise("ok").alias("status")))


@query(f"""WITH p AS (SELECT event_type, count(value)::BIGINT AS n, sum((value IS NULL)::INT)::BIGINT AS n_null, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS v_min, max(value) AS v_max, skewness(value) AS skew, kurtosis(value) AS kurt, avg((value = 0)::INT) AS zero_share, avg((value > 0)::INT) AS positive_share,
  count(DISTINCT value)::BIGINT AS n_distinct, {", ".join(f"quantile_cont(value, {q}) AS p{n}" for n, q in (("01", 0.01), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("99", 0.99)))} FROM events GROUP BY 1)
  SELECT event_type, n, n_null, {r("mean", "std", "v_min", "v_max", "skew", "kurt", "zero_share", "positive_share", "p01", "p25", "p50", "p75", "p99", digits=5)}, n_distinct FROM p""")
def numeric_profile(spark, sf_dir):
    return rounded(ag.numeric_profile(table(spark, sf_dir, "events"), ["event_type"], "value"), 5)


@query("""SELECT o_orderpriority, arg_min(o_orderstatus, (-n, o_orderstatus)) AS mode, count(*)::BIGINT AS n_values FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def mode_by_group(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return c.groupBy("o_orderpriority").agg(F.min_by("o_orderstatus", F.struct(-F.col("n"), F.col("o_orderstatus"))).alias("mode"), F.count("*").alias("n_values"))


@query(f"""WITH {BARS} SELECT k, t, {r("open", "high", "low", "close", "total")}, n FROM bars""")
def resample_ohlc(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query("""WITH e AS (SELECT user_id, event_id, ts, date_trunc('day', ts) AS src FROM events) SELECT user_id, src, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM e GROUP BY 1, 2""")
def source_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("src"))
    return resample.collapse_to_source(e, ["user_id"], "src", "ts").select("user_id", "src", "event_id", "ts")


@query("""SELECT (CASE WHEN value = 200 THEN 20 ELSE floor(value / 10) + 1 END)::BIGINT AS bin, count(*)::BIGINT AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1""")
def value_histogram(spark, sf_dir):
    return ag.histogram(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 20)


@query(f"""WITH {BARS}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM bars), q AS (SELECT quantile_cont(close, 0.95) AS q FROM bars), e AS (SELECT k, i FROM i, q WHERE close >= q)
  SELECT d.o AS "offset", round(quantile_cont(close, 0.5), 6) + 0.0 AS median, round(avg(close), 6) + 0.0 AS mean, count(close)::BIGINT AS n FROM e, (SELECT unnest(range(-3, 7)) AS o) d JOIN i ON i.k = e.k AND i.i = e.i + d.o GROUP BY 1""")
def event_study(spark, sf_dir):
    from chronoloom.operators.joins import with_thresholds

    b = bars(spark, sf_dir)
    b = with_thresholds(b, b.agg(F.percentile("close", 0.95).alias("q"))).withColumn("event", F.col("close") >= F.col("q"))
    return rounded(ag.event_study(b, ["k"], "t", "close", "event", 3, 6))


@query("""WITH o AS (SELECT o_orderpriority, o_orderkey, o_totalprice, o_orderdate < TIMESTAMP '1998-01-01' AS train FROM orders) SELECT o_orderkey, round((SELECT count(*) FROM o t WHERE t.train AND t.o_orderpriority = o.o_orderpriority AND t.o_totalprice <= o.o_totalprice) / (SELECT count(*) FROM o t WHERE t.train AND t.o_orderpriority = o.o_orderpriority), 6) + 0.0 AS u FROM o""")
def empirical_cdf(spark, sf_dir):
    out = ag.empirical_cdf(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return rounded(out.select("o_orderkey", "u"))


@query("""SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3""")
def top_per_group(spark, sf_dir):
    return selection.top_per_group(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 3).select("event_type", "event_id", "ts")


@query("""SELECT event_id, value FROM ((SELECT * FROM events ORDER BY value DESC, event_id LIMIT 25) UNION (SELECT * FROM events ORDER BY value, event_id LIMIT 25))""")
def extreme_rows(spark, sf_dir):
    return selection.extremes(table(spark, sf_dir, "events"), "value", "event_id", 25).select("event_id", "value")


@query(f"""WITH {BARS} SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM bars) WHERE i % 7 = 0""")
def stride_thinning(spark, sf_dir):
    return selection.every_nth(bars(spark, sf_dir), ["k"], "t", 7).select("k", "t")


@query(f"""WITH {BARS}, i AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM bars), p AS (SELECT DISTINCT k, floor(j * (n - 1) / 49 + 1e-9)::BIGINT AS i FROM (SELECT DISTINCT k, n FROM i), (SELECT unnest(range(50)) AS j) WHERE n > 50)
  SELECT i.k, i.t FROM i LEFT JOIN p ON p.k = i.k AND p.i = i.i WHERE n <= 50 OR p.i IS NOT NULL""")
def even_thinning(spark, sf_dir):
    return selection.evenly_thinned(bars(spark, sf_dir), ["k"], "t", 50).select("k", "t")


@query(f"""WITH {BARS}, b AS (SELECT k, t, close, (row_number() OVER (PARTITION BY k ORDER BY t) - 1) // 24 AS b FROM bars), p AS (SELECT k, b, unnest([min(t), max(t), arg_min(t, (close, t)), arg_max(t, (close, -epoch_us(t)))]) AS t FROM b GROUP BY 1, 2)
  SELECT DISTINCT b.k, b.t, round(b.close, 6) + 0.0 AS close FROM p JOIN b ON b.k = p.k AND b.t = p.t""")
def min_max_downsample(spark, sf_dir):
    return rounded(selection.min_max_sampled(bars(spark, sf_dir), ["k"], "t", "close", 24))


@query("""SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 7""")
def frequent_values(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(7)


OHLC_NAMES = ("high_not_below", "low_not_above", "prices_positive")


@query(f"""WITH {BARS}, c AS (SELECT count(*) AS n, sum((NOT (high >= greatest(open, close) AND high >= low))::INT) AS a, sum((NOT low <= least(open, close))::INT) AS b, sum((NOT (open > 0 AND high > 0 AND low > 0 AND close > 0))::INT) AS c, sum((NOT n BETWEEN 1 AND 2)::INT) AS d FROM bars),
  u AS (SELECT 'high_not_below' AS "check", a AS bad, n, 0.0 AS f FROM c UNION ALL SELECT 'low_not_above', b, n, 0.0 FROM c UNION ALL SELECT 'prices_positive', c, n, 0.0 FROM c UNION ALL SELECT 'n_in_range', d, n, 0.0 FROM c)
  SELECT "check", bad::BIGINT AS n_bad, n::BIGINT AS n_rows, CASE WHEN bad = 0 THEN 'PASS' WHEN bad > f * n THEN 'FAIL' ELSE 'WARN' END AS status FROM u""")
def quality_checks(spark, sf_dir):
    return checks.run_checks(bars(spark, sf_dir), [*checks.ohlc_checks(), checks.between("n", 1, 2)])


@query(f"""WITH {BARS}, s AS (SELECT k, t, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY k ORDER BY t))) / 1e6 AS s FROM bars), m AS (SELECT k, quantile_cont(s, 0.5) AS m FROM s GROUP BY 1)
  SELECT s.k, count(*)::BIGINT AS n_rows, 0::BIGINT AS n_duplicates, any_value(m) AS median_step, max(s) AS max_step, sum((coalesce(s, 0) > 1.5 * m)::INT)::BIGINT AS n_gaps FROM s JOIN m ON m.k = s.k GROUP BY 1""")
def time_profile(spark, sf_dir):
    return checks.time_profile(bars(spark, sf_dir), ["k"], "t")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), x AS (SELECT event_type, avg((value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))::INT) AS iqr_share, avg((abs(value - m) > 6 * s)::INT) AS z_share FROM events JOIN q USING (event_type) GROUP BY 1)
  SELECT event_type, round(iqr_share, 6) + 0.0 AS iqr_share, round(z_share, 6) + 0.0 AS z_share, CASE WHEN iqr_share > 0.05 THEN 'FAIL' WHEN iqr_share > 0.01 THEN 'WARN' ELSE 'PASS' END AS verdict FROM x""")
def outlier_profile(spark, sf_dir):
    return rounded(checks.outlier_profile(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(f"""SELECT event_id, {r("soft", "sq", "sig", "tan", "half", "fresh")}, slug FROM (SELECT event_id, ln(1 + exp(-abs(value / 50))) + greatest(value / 50, 0) AS soft, 1 - exp(-value / 30) AS sq, 1 / (1 + exp(-least(greatest(value / 10, -50), 50))) AS sig, tanh(value / 100) AS tan, pow(2, -value / 24) AS half, exp(-greatest(value - 60, 0) / 60) AS fresh,
  regexp_replace(regexp_replace(lower(trim(event_type || ' / ' || user_id)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM events)""")
def scalar_formulas(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), F.col("value")
    slug = sc.slug(F.concat("event_type", F.lit(" / "), F.col("user_id").cast("string")))
    return rounded(e.select("event_id", sc.softplus(v / 50).alias("soft"), sc.squash(v, 30).alias("sq"), sc.sigmoid(v / 10).alias("sig"), F.tanh(v / 100).alias("tan"), sc.half_life(v, 24).alias("half"), sc.freshness(v, 60, 60).alias("fresh"), slug.alias("slug")))


@query(f"""WITH {FLOWS}, x AS (SELECT t, fl + fs AS total, fl - fs AS diff, CASE WHEN fl + fs > 1e-12 THEN fl / (fl + fs + 1e-12) ELSE 0.5 END AS ratio, CASE WHEN fl + fs > 1e-12 THEN (fl - fs) / (fl + fs + 1e-12) ELSE 0 END AS sdom FROM flows)
  SELECT t, {r("total", "diff", "ratio", "sdom")}, CASE WHEN total > 0 THEN 1 ELSE 0 END AS active FROM x""")
def flow_features(spark, sf_dir):
    """The clean two-sided frame: total, difference, share of one side, signed dominance."""
    f = flows(spark, sf_dir).withColumn("total", F.col("fl") + F.col("fs"))
    return rounded(f.select("t", "total", (F.col("fl") - F.col("fs")).alias("diff"), sc.safe_ratio("fl", "total", 0.5).alias("ratio"), sc.safe_ratio(F.col("fl") - F.col("fs"), "total", 0.0).alias("sdom"), F.when(F.col("total") > 0, 1).otherwise(0).alias("active")))


_Z_PARTS = {"z_log_total": "ln(1 + fl + fs)", "z_log_long": "ln(1 + fl)", "z_log_short": "ln(1 + fs)", "z_sdom": "CASE WHEN fl + fs > 1e-12 THEN (fl - fs) / (fl + fs + 1e-12) ELSE 0 END"}


@query(f"""WITH {FLOWS}, m AS (SELECT t, k, {", ".join(f"{x} AS {n}_x, CASE WHEN count(*) OVER w >= 20 THEN quantile_cont({x}, 0.5) OVER w END AS {n}_m" for n, x in _Z_PARTS.items())} FROM flows WINDOW w AS (PARTITION BY k ORDER BY t ROWS 23 PRECEDING)),
  d AS (SELECT *, {", ".join(f"abs({n}_x - {n}_m) AS {n}_d" for n in _Z_PARTS)} FROM m)
  SELECT t, {", ".join(f"round(({n}_x - {n}_m) / nullif(1.4826 * CASE WHEN count({n}_d) OVER w >= 20 THEN quantile_cont({n}_d, 0.5) OVER w END, 0), 6) + 0.0 AS {n}" for n in _Z_PARTS)} FROM d WINDOW w AS (PARTITION BY k ORDER BY t ROWS 23 PRECEDING)""")
def model_z_features(spark, sf_dir):
    f = flows(spark, sf_dir)
    parts = {"z_log_total": F.log1p(F.col("fl") + F.col("fs")), "z_log_long": F.log1p("fl"), "z_log_short": F.log1p("fs"), "z_sdom": sc.safe_ratio(F.col("fl") - F.col("fs"), F.col("fl") + F.col("fs"), 0.0)}
    for name, x in parts.items():
        f = wn.nested_mad_z(f.withColumn("x", x), ["k"], "t", "x", 24, 20, name)
    return rounded(f.select("t", *parts))


@query(f"""WITH {FLOWS}, x AS (SELECT *, fl - fs AS diff FROM flows), q AS (SELECT t, diff, {", ".join(f"CASE WHEN count(diff) OVER w >= 24 THEN quantile_cont(diff, {p}) OVER w END AS q{int(p * 100)}" for p in (0.2, 0.4, 0.6, 0.8))}, CASE WHEN fl + fs > 1e-12 THEN fl / (fl + fs + 1e-12) ELSE 0.5 END AS rpn, extract(hour FROM t) % 9 AS bin FROM x WINDOW w AS (PARTITION BY k ORDER BY t ROWS 71 PRECEDING))
  SELECT t, CASE WHEN bin <= 3 AND diff <= q20 OR bin = 4 AND rpn <= 0.48 AND diff <= q40 THEN 1 WHEN bin >= 5 AND diff >= q80 OR bin = 4 AND rpn >= 0.52 AND diff >= q60 THEN -1 ELSE 0 END AS dominance FROM q""")
def dominance_state(spark, sf_dir):
    """First-match decision between the two sides by bin, ratio and rolling quantiles of the difference."""
    f = flows(spark, sf_dir).withColumn("diff", F.col("fl") - F.col("fs"))
    f = ranks.rolling_quantiles(f, ["k"], "t", "diff", {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8}, least=24, rows=72)
    f = f.withColumn("rpn", sc.safe_ratio("fl", F.col("fl") + F.col("fs"), 0.5)).withColumn("bin", F.hour("t") % 9)
    c = F.col
    up = ((c("bin") <= 3) & (c("diff") <= c("q20"))) | ((c("bin") == 4) & (c("rpn") <= 0.48) & (c("diff") <= c("q40")))
    down = ((c("bin") >= 5) & (c("diff") >= c("q80"))) | ((c("bin") == 4) & (c("rpn") >= 0.52) & (c("diff") >= c("q60")))
    return f.select("t", F.when(up, 1).when(down, -1).otherwise(0).alias("dominance"))
