"""Queries: data behind reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY
from chronoloom.operators import reports as rp
from chronoloom.plans.registry import BARS, bars, query, r, rounded, table


@query("""SELECT event_id, value FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 7 * 86400000000""")
def trailing_window(spark, sf_dir):
    return rp.trailing(table(spark, sf_dir, "events"), "ts", 7 * DAY).select("event_id", "value")


@query("""SELECT event_id FROM events WHERE ts + INTERVAL 3 DAY <= (SELECT max(ts) FROM events)""")
def matured_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rp.matured(e.withColumn("av", F.col("ts") + F.expr("INTERVAL 3 DAYS")), "av", e, "ts").select("event_id")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2""")
def last_two_rows(spark, sf_dir):
    return rp.last_rows(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id")


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a, b in _PAIRS))
def correlation_pairs(spark, sf_dir):
    return rounded(rp.correlations(table(spark, sf_dir, "lineitem"), _COLS))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a, b in _PAIRS) + ") ORDER BY abs(corr) DESC, a, b LIMIT 2")
def high_correlations(spark, sf_dir):
    return rounded(rp.high_pairs(rp.correlations(table(spark, sf_dir, "lineitem"), _COLS), 0.0, 2))


_AGE = "a AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0 AS age FROM events)"


@query(f"""WITH {_AGE} SELECT 'last_event' AS name, round(count(age) / count(*), 6) + 0.0 AS share, round(quantile_cont(age, 0.5), 6) + 0.0 AS p50, round(quantile_cont(age, 0.9), 6) + 0.0 AS p90, round(quantile_cont(age, 0.99), 6) + 0.0 AS p99 FROM a""")
def staleness_quantiles(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    a = table(spark, sf_dir, "events").withColumn("age", (us(F.col("ts")) - us(F.lag("ts").over(w))) / 3600e6)
    return rounded(rp.staleness(a, {"last_event": "age"}))


@query("""SELECT 'l_discount' AS "column", round(avg((NOT l_discount BETWEEN 0.01 AND 0.09)::INT), 6) + 0.0 AS outside FROM lineitem UNION ALL SELECT 'l_tax', round(avg((NOT l_tax BETWEEN 0 AND 0.05)::INT), 6) + 0.0 FROM lineitem""")
def outside_ranges(spark, sf_dir):
    return rounded(rp.range_rates(table(spark, sf_dir, "lineitem"), {"l_discount": (0.01, 0.09), "l_tax": (0.0, 0.05)}))


@query(f"""WITH q AS (SELECT event_type, count(value)::BIGINT AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
  SELECT event_type, n, {r("q1", "q2", "q3")}, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) + 0.0 AS low, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS high FROM q""")
def box_statistics(spark, sf_dir):
    return rounded(rp.box_statistics(table(spark, sf_dir, "events"), "event_type", "value"))


@query(f"""WITH {BARS} SELECT k, t, round(avg((n < 2)::INT) OVER (PARTITION BY k ORDER BY t ROWS 23 PRECEDING), 6) + 0.0 AS missing FROM bars""")
def rolling_missing(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("v", F.when(F.col("n") >= 2, F.col("close")))
    return rounded(b.select("k", "t", rp.rolling_missing(F.col("v"), ["k"], "t", 24).alias("missing")))


@query("""WITH x AS (SELECT 'large' AS example, event_id, value FROM events WHERE value > 150 UNION ALL SELECT 'small_click', event_id, value FROM events WHERE value < 5 AND event_type = 'click' UNION ALL SELECT 'error', event_id, value FROM events WHERE event_type = 'error')
  SELECT example, event_id FROM x QUALIFY row_number() OVER (PARTITION BY example ORDER BY value DESC, event_id) = 1""")
def best_examples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    checks = {"large": F.col("value") > 150, "small_click": (F.col("value") < 5) & (F.col("event_type") == "click"), "error": F.col("event_type") == "error"}
    return rp.best_examples(e, checks, [F.desc("value"), F.asc("event_id")]).select("example", "event_id")


@query("""SELECT 'o_orderkey' AS "column", count(*)::BIGINT AS n_rows, sum((o_orderkey IS NULL)::INT)::BIGINT AS n_null, min(o_orderkey)::VARCHAR AS lowest, max(o_orderkey)::VARCHAR AS highest FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*), sum((o_orderstatus IS NULL)::INT)::BIGINT, min(o_orderstatus), max(o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', count(*), sum((o_totalprice IS NULL)::INT)::BIGINT, NULL, NULL FROM orders""")
def frame_overview(spark, sf_dir):
    """Without the approximate distinct counts, and without the ends of doubles, whose text differs between engines."""
    out = rp.overview(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])
    ends = [F.when(F.col("column") != "o_totalprice", F.col(c)).alias(c) for c in ("lowest", "highest")]
    return out.select("column", "n_rows", "n_null", *ends)
