"""Queries: scans, cleaning, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import HOUR
from chronoloom.functions.scalar import finite, number
from chronoloom.operators import joins, resample, selection
from chronoloom.operators.asof import anchor, asof_join
from chronoloom.plans.registry import BARS, bars, query, r, rounded, table


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def dedup_keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return resample.keep_last(e.select("user_id", "hour", "ts", "event_id", "event_type", "value"), ["user_id", "hour"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_type, count(*)::BIGINT AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, max((props->>'k')::BIGINT) AS k_max FROM events GROUP BY 1""")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query(f"""SELECT o_orderpriority, {r("total", "mean")}, n_text FROM (SELECT o_orderpriority, sum(o_totalprice) AS total, avg(o_totalprice) AS mean,
  count(TRY_CAST(o_orderpriority AS DOUBLE))::BIGINT AS n_text FROM orders GROUP BY 1)""")
def null_policy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("_p", finite("o_totalprice")).withColumn("_t", number("o_orderpriority"))
    return rounded(o.groupBy("o_orderpriority").agg(F.sum("_p").alias("total"), F.avg("_p").alias("mean"), F.count("_t").alias("n_text")))


@query("""SELECT l.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
  ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON l.user_id = p.user_id AND l.ts >= p.ts""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("last_purchase"))
    out = asof_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), p, "ts", ["user_id"], ["last_purchase"], tie="event_id")
    return out.select("event_id", "last_purchase")


@query("""SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(p.av) <= 43200000000 THEN p.value END AS seen,
  CASE WHEN epoch_us(l.ts) - epoch_us(p.av) <= 43200000000 THEN (epoch_us(l.ts) - epoch_us(p.av))::BIGINT END AS age_us
  FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
  ASOF LEFT JOIN (SELECT user_id, ts + INTERVAL 50 MINUTE AS av, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON l.user_id = p.user_id AND l.ts >= p.av""")
def asof_offset_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("seen"))
    left = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(left, p, "ts", ["user_id"], ["seen"], offset=50 * HOUR // 60, tolerance=12 * HOUR, tie="event_id", age="age_us").select("event_id", "seen", "age_us")


@query(f"""WITH {BARS} SELECT a.k, a.t, b.close AS anchor FROM bars a ASOF LEFT JOIN bars b ON a.k = b.k AND a.t - INTERVAL 6 HOUR >= b.t
  QUALIFY true""".replace("QUALIFY true", "").replace("b.close AS anchor", "CASE WHEN b.t >= a.t - INTERVAL 9 HOUR THEN b.close END AS anchor"))
def asof_self_anchor(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("k", "t", anchor(b, ["k"], "t", "close", 6 * HOUR, 3 * HOUR).alias("anchor"))


@query(f"""WITH {BARS} SELECT a.t, {r("a_close", "b_close", "c_close")} FROM (SELECT a.t, a.close AS a_close, b.close AS b_close, c.close AS c_close
  FROM bars a JOIN bars b USING (t) JOIN bars c USING (t) WHERE a.k = 'click' AND b.k = 'view' AND c.k = 'purchase') a""")
def time_join_three(spark, sf_dir):
    b = bars(spark, sf_dir)
    one = lambda k, n: b.where(F.col("k") == k).select("t", F.col("close").alias(n))
    return rounded(joins.time_join([one("click", "a_close"), one("view", "b_close"), one("purchase", "c_close")], ["t"]))


@query(f"""WITH {BARS} SELECT a.k, a.t, h1.close AS c1, h6.close AS c6 FROM bars a LEFT JOIN bars h1 ON h1.k = a.k AND h1.t = a.t + INTERVAL 1 HOUR
  LEFT JOIN bars h6 ON h6.k = a.k AND h6.t = a.t + INTERVAL 6 HOUR""")
def label_lookup(spark, sf_dir):
    b = bars(spark, sf_dir).select("k", "t", "close")
    out = joins.label_lookup(b, ["k"], "t", "close", F.expr("INTERVAL 1 HOUR"), "c1")
    six = joins.label_lookup(b, ["k"], "t", "close", F.expr("INTERVAL 6 HOUR"), "c6").drop("close")
    return out.join(six, ["k", "t"]).select("k", "t", "c1", "c6")


@query(f"""WITH {BARS}, ref AS (SELECT k, t, CASE WHEN n > 2 THEN close END AS close, open FROM bars WHERE t < TIMESTAMP '2024-01-15')
  SELECT b.k, b.t, CASE WHEN ref.t IS NOT NULL THEN ref.close ELSE b.close END AS close, b.high FROM bars b LEFT JOIN ref ON ref.k = b.k AND ref.t = b.t""")
def overlay_history(spark, sf_dir):
    b = bars(spark, sf_dir)
    ref = b.where("t < TIMESTAMP_NTZ '2024-01-15'").select("k", "t", F.when(F.col("n") > 2, F.col("close")).alias("close"), "open")
    return joins.overlay(b.select("k", "t", "close", "high"), ref, ["k", "t"], ["close"])


@query(f"""WITH {BARS}, e AS (SELECT k, min(t) AS lo, max(t) AS hi FROM bars GROUP BY 1), g AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM e)
  SELECT g.k, g.t FROM g ANTI JOIN bars b ON b.k = g.k AND b.t = g.t""")
def missing_times(spark, sf_dir):
    return joins.missing_times(bars(spark, sf_dir), ["k"], "t", F.expr("INTERVAL 1 HOUR"))


@query("""WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 20)
  SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 6) + 0.0 AS total FROM events SEMI JOIN top USING (user_id) GROUP BY 1""")
def semi_join_top(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
    return rounded(e.join(top, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


FOLDS = "(VALUES (0, TIMESTAMP '1995-01-01', TIMESTAMP '1996-07-01'), (1, TIMESTAMP '1995-04-01', TIMESTAMP '1996-10-01'), (2, TIMESTAMP '1995-07-01', TIMESTAMP '1997-01-01')) f(fold, fold_start, fold_end)"


@query(f"""SELECT fold, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) + 0.0 AS mean FROM orders JOIN {FOLDS} ON o_orderdate >= fold_start AND o_orderdate < fold_end GROUP BY 1""")
def fold_range_join(spark, sf_dir):
    folds = spark.sql("SELECT fold, fold_start::timestamp_ntz, fold_end::timestamp_ntz FROM VALUES (0, '1995-01-01', '1996-07-01'), (1, '1995-04-01', '1996-10-01'), (2, '1995-07-01', '1997-01-01') f(fold, fold_start, fold_end)")
    out = joins.fold_members(table(spark, sf_dir, "orders"), folds, "o_orderdate").groupBy("fold").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return rounded(out)


@query("""WITH s AS (SELECT quantile_cont(value, 0.7) AS q70, quantile_cont(value, 0.3) AS q30 FROM events WHERE ts < TIMESTAMP '2024-01-20')
  SELECT event_type, count(*) FILTER (value >= q70)::BIGINT AS n_high, count(*) FILTER (value <= q30)::BIGINT AS n_low FROM events, s GROUP BY 1""")
def train_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("ts < TIMESTAMP_NTZ '2024-01-20'").agg(F.percentile("value", 0.7).alias("q70"), F.percentile("value", 0.3).alias("q30"))
    return joins.with_thresholds(e, s).groupBy("event_type").agg(F.count_if(F.col("value") >= F.col("q70")).alias("n_high"), F.count_if(F.col("value") <= F.col("q30")).alias("n_low"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
  a AS (SELECT n_regionkey, c_mktsegment, avg(c_acctbal) AS v, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT n_regionkey, avg(c_acctbal) AS v, count(*) AS n FROM c GROUP BY 1), g AS (SELECT avg(c_acctbal) AS v FROM c)
  SELECT c_custkey, round(CASE WHEN a.n >= 60 THEN a.v WHEN b.n >= 300 THEN b.v ELSE g.v END, 6) + 0.0 AS expected FROM c LEFT JOIN a USING (n_regionkey, c_mktsegment) LEFT JOIN b USING (n_regionkey), g""".replace("b.n >= 300", "b.n >= 60"))
def fallback_buckets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey").select("c_custkey", "c_acctbal", "c_mktsegment", "n_regionkey")
    level = lambda *k: (list(k), c.groupBy(*k).agg(F.avg("c_acctbal").alias("v"), F.count("*").alias("n")))
    out = joins.fallback_lookup(c, [level("n_regionkey", "c_mktsegment"), level("n_regionkey"), level()], "v", "n", 60, "expected")
    return rounded(out.select("c_custkey", "expected"))


@query(f"""WITH {BARS} SELECT t, {r("click", "view", "purchase")} FROM (SELECT t, max(close) FILTER (k = 'click') AS click, max(close) FILTER (k = 'view') AS view, max(close) FILTER (k = 'purchase') AS purchase FROM bars GROUP BY 1)""")
def pivot_wide(spark, sf_dir):
    return rounded(bars(spark, sf_dir).groupBy("t").pivot("k", ["click", "view", "purchase"]).agg(F.first("close")))


@query(f"""WITH {BARS}, old AS (SELECT k, t, close, 0 AS v FROM bars WHERE t < TIMESTAMP '2024-01-20'), new AS (SELECT k, t, close + 1 AS close, 1 AS v FROM bars WHERE t >= TIMESTAMP '2024-01-19')
  SELECT k, t, {r("close")}, v FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (k, t))""")
def upsert_rows(spark, sf_dir):
    b = bars(spark, sf_dir).select("k", "t", "close")
    old = b.where("t < TIMESTAMP_NTZ '2024-01-20'").withColumn("v", F.lit(0))
    new = b.where("t >= TIMESTAMP_NTZ '2024-01-19'").withColumn("close", F.col("close") + 1).withColumn("v", F.lit(1))
    return rounded(joins.upsert(old, new, ["k", "t"]))


@query(f"""WITH {BARS}, m AS (SELECT max(t) AS m FROM bars WHERE t < TIMESTAMP '2024-01-20')
  SELECT k, t, n, CASE WHEN t <= m THEN 'cached' ELSE 'new' END AS origin FROM bars, m""")
def incremental_append(spark, sf_dir):
    b = bars(spark, sf_dir).select("k", "t", "n")
    cache = b.where("t < TIMESTAMP_NTZ '2024-01-20'").withColumn("origin", F.lit("cached"))
    return joins.append_newer(cache, b.withColumn("origin", F.lit("new")), "t")


@query(f"""WITH {BARS} SELECT t FROM bars WHERE k = 'click' INTERSECT SELECT t FROM bars WHERE k = 'error'""")
def intersect_times(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.where("k = 'click'").select("t").intersect(b.where("k = 'error'").select("t"))


@query(f"""WITH {BARS} SELECT t FROM bars WHERE k = 'click' EXCEPT SELECT t FROM bars WHERE k = 'error'""")
def except_times(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.where("k = 'click'").select("t").subtract(b.where("k = 'error'").select("t"))


@query(f"""WITH {BARS}, h AS (SELECT k, t, close, lag(close, 1) OVER w AS p1, lag(close, 3) OVER w AS p3, lag(close, 6) OVER w AS p6 FROM bars WINDOW w AS (PARTITION BY k ORDER BY t))
  SELECT k, h AS horizon, count(m)::BIGINT AS n, round(avg(m), 6) + 0.0 AS mean FROM (SELECT k, 1 AS h, close - p1 AS m FROM h UNION ALL SELECT k, 3, close - p3 FROM h UNION ALL SELECT k, 6, close - p6 FROM h) GROUP BY 1, 2""")
def union_horizons(spark, sf_dir):
    from chronoloom.functions.frames import ordered

    b = bars(spark, sf_dir)
    moves = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col("close") - F.lag("close", h).over(ordered(["k"], "t"))).alias("m")) for h in (1, 3, 6)])
    long = b.select("k", moves.alias("_m")).select("k", F.inline("_m"))
    return rounded(long.groupBy("k", "horizon").agg(F.count("m").alias("n"), F.avg("m").alias("mean")))


@query(f"""WITH {BARS} , p AS (SELECT event_id, event_type AS k, ts AS t FROM events),
  j AS (SELECT p.event_id, p.t, epoch_us(a.t) AS ta, a.close AS va FROM p ASOF LEFT JOIN bars a ON a.k = p.k AND p.t >= a.t), q AS (SELECT p.event_id, epoch_us(b.t) AS tb, b.close AS vb FROM p ASOF LEFT JOIN bars b ON b.k = p.k AND p.t <= b.t)
  SELECT event_id, round(CASE WHEN tb = ta THEN va ELSE va + (vb - va) * (epoch_us(t) - ta) / (tb - ta) END, 6) + 0.0 AS price FROM j JOIN q USING (event_id)""")
def interpolated_at_events(spark, sf_dir):
    """A price for every event, on the line between the bars around it."""
    return _interpolated(spark, sf_dir, table(spark, sf_dir, "events"))


@query(f"""WITH {BARS} , p AS (SELECT event_id, event_type AS k, ts AS t FROM events),
  j AS (SELECT p.event_id, p.t, epoch_us(a.t) AS ta, a.close AS va FROM p ASOF LEFT JOIN bars a ON a.k = p.k AND p.t >= a.t), q AS (SELECT p.event_id, epoch_us(b.t) AS tb, b.close AS vb FROM p ASOF LEFT JOIN bars b ON b.k = p.k AND p.t <= b.t)
  SELECT event_id, round(CASE WHEN tb = ta THEN va ELSE va + (vb - va) * (epoch_us(t) - ta) / (tb - ta) END, 6) + 0.0 AS price FROM j JOIN q USING (event_id)""")
def interpolated_at_all_events(spark, sf_dir):
    return _interpolated(spark, sf_dir, table(spark, sf_dir, "events"))


def _interpolated(spark, sf_dir, events):
    b = bars(spark, sf_dir).select("k", "t", "close")
    e = events.select("event_id", F.col("event_type").alias("k"), F.col("ts").alias("t"))
    return rounded(selection.interpolated_at(b, e, ["k"], "t", "close", "price").select("event_id", "price"))
