"""Queries: composed stages, validators and reports, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY
from chronoloom.operators import checks as ck, regime as rg, stages as st
from chronoloom.plans.registry import BARS, FLOWS, bars, flows, query, r, rounded, table

E = "1e-12"
SETTINGS = st.ObservationSettings(lookback=14 * DAY, least=48)


def five_states() -> rg.Gaussians:
    """Five states along the first feature, from long to short."""
    move = np.full((5, 5), 0.02) + np.eye(5) * 0.90
    means = np.array([[m, 0.8 * m, 0.0] for m in (-1.5, -0.7, 0.0, 0.7, 1.5)])
    return rg.Gaussians(np.full(5, 0.2), move, means, np.full((5, 3), 0.8))


@query()
def canonical_family(spark, sf_dir):
    """Smoothed sides of the hourly flows; a test restates what follows from the levels."""
    return rounded(st.canonical_family(flows(spark, sf_dir), ["k"], "t", "fl", "fs", history=128, level=3))


@query()
def regime_applied(spark, sf_dir):
    """The regime of every hourly row, decided on a two-hour source clock; a test restates the chain row by row."""
    f = flows(spark, sf_dir).withColumn("source_t", F.date_trunc("day", "t").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(F.hour("t") / 2) * 2).cast("int")))
    return rounded(st.apply_regime(f, ["k"], "source_t", "t", "fl", "fs", five_states(), SETTINGS))


@query(f"""WITH {FLOWS}, d AS (SELECT t, fl, fs, fl - lag(fl) OVER (ORDER BY t) AS a, fs - lag(fs) OVER (ORDER BY t) AS b FROM flows)
  SELECT t, CASE WHEN a > 0 AND b > 0 AND fl > fs THEN 'LUSUL' WHEN a > 0 AND b > 0 THEN 'LUSUS' WHEN a < 0 AND b < 0 AND fl > fs THEN 'LDSDL' WHEN a < 0 AND b < 0 THEN 'LDSDS'
    WHEN a > 0 AND b < 0 AND fl > fs THEN 'LUSDL' WHEN a > 0 AND b < 0 THEN 'LUSDS' WHEN a < 0 AND b > 0 AND fl > fs THEN 'LDSUL' WHEN a < 0 AND b > 0 THEN 'LDSUS' ELSE 'None' END AS delta_case FROM d""")
def delta_cases(spark, sf_dir):
    w = st.ordered(["k"], "t")
    f = flows(spark, sf_dir).withColumns({"a": F.col("fl") - F.lag("fl").over(w), "b": F.col("fs") - F.lag("fs").over(w)})
    return f.select("t", st.delta_case(F.col("fl"), F.col("fs"), F.col("a"), F.col("b")).alias("delta_case"))


@query(f"""WITH {BARS}, m AS (SELECT k, quantile_cont(abs(close - open), 0.5) AS s FROM bars GROUP BY 1) SELECT k, t, round(asinh((close - open) / (s + {E})), 6) + 0.0 AS z FROM bars JOIN m USING (k)""")
def arcsinh_scaled(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("move", F.col("close") - F.col("open"))
    return rounded(st.arcsinh_scaled(b, ["k"], "move", "z").select("k", "t", "z"))


@query(f"""WITH src AS (SELECT event_type, date_trunc('hour', ts) AS source_t, arg_max(CASE WHEN value > 50 THEN 1 ELSE -1 END, (ts, event_id)) AS d, arg_max(value / 1000, (ts, event_id)) AS rel, arg_max(value, (ts, event_id)) AS m FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
  b AS (SELECT event_id, event_type, date_trunc('hour', ts) AS source_t, CASE WHEN event_id % 11 <> 0 THEN (event_id % 240)::DOUBLE END AS age FROM events),
  j AS (SELECT event_id, d, m, CASE WHEN age IS NULL THEN 0 ELSE exp(-greatest(age - 60, 0) / 60) END AS freshness, coalesce(rel, 0) * CASE WHEN age IS NULL THEN 0 ELSE exp(-greatest(age - 60, 0) / 60) END AS bar_reliability FROM b LEFT JOIN src USING (event_type, source_t))
  SELECT event_id, {r("freshness", "bar_reliability")}, round(coalesce(d, 0) * coalesce(m, 0) * bar_reliability, 6) + 0.0 AS main_size FROM j""")
def source_on_bars(spark, sf_dir):
    """Events of one source hour on all events of that hour, with freshness by the age of the snapshot."""
    e, v = table(spark, sf_dir, "events").withColumn("source_t", F.date_trunc("hour", "ts")), F.col("value")
    src = e.where("event_type <> 'view'").select("event_type", "source_t", "ts", "event_id", F.when(v > 50, 1).otherwise(-1).alias("d"), (v / 1000).alias("rel"), v.alias("m"))
    b = e.select("event_id", "event_type", "source_t", F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 240).cast("double")).alias("age"))
    out = st.on_bars(b, src.withColumnRenamed("event_id", "src_id"), ["event_type"], "source_t", ["ts", "src_id"], "age", "d", "rel", {"size": "m"}, "size")
    return rounded(out.select("event_id", "freshness", "bar_reliability", "main_size"))


@query(f"""WITH {BARS}, s AS (SELECT k, quantile_cont(d, 0.5) * 1.5 AS most FROM (SELECT k, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY k ORDER BY t) AS d FROM bars) GROUP BY 1),
  e AS (SELECT event_id, event_type AS k, ts AS t FROM events), j AS (SELECT e.event_id, e.k, bars.close, epoch_us(e.t) - epoch_us(bars.t) AS age FROM e ASOF LEFT JOIN bars ON e.k = bars.k AND e.t >= bars.t)
  SELECT event_id, CASE WHEN age <= most THEN age END AS age, round(CASE WHEN age <= most THEN close END, 6) + 0.0 AS close FROM j LEFT JOIN s USING (k)""")
def asof_median_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("k"), F.col("ts").alias("t"))
    return rounded(st.asof_median_bars(e, bars(spark, sf_dir).select("k", "t", "close"), "t", ["k"], ["close"]).select("event_id", "age", "close"))


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share, """ + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}_mean, round(quantile_cont({c}, 0.5), 4) + 0.0 AS {c}_median" for c in ("l_quantity", "l_discount", "l_tax")) + " FROM (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) GROUP BY 1")
def state_semantics(spark, sf_dir):
    columns = ("l_quantity", "l_discount", "l_tax")
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in columns])
    out = rounded(st.state_semantics(l, "l_returnflag", columns).withColumn("share", F.round("share", 6)), 6)
    return out.withColumns({f"{c}_{n}": F.round(f"{c}_{n}", 4) + F.lit(0.0) for c in columns for n in ("mean", "median")})


@query("""WITH x AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split, CASE WHEN event_id % 5 > 0 THEN value END AS e_value, (event_id % 97)::DOUBLE AS score_id FROM events),
  m AS (SELECT split, 'e_value' AS feature, e_value AS v FROM x UNION ALL SELECT split, 'score_id', score_id FROM x)
  SELECT split, feature, round(avg(v), 4) + 0.0 AS mean, round(quantile_cont(v, 0.5), 4) + 0.0 AS median, round(quantile_cont(v, 0.9), 4) + 0.0 AS p90, round(avg((v IS NULL)::INT), 4) + 0.0 AS missing_rate FROM m GROUP BY 1, 2""")
def evidence_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("test").alias("split"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("e_value"), (F.col("event_id") % 97).cast("double").alias("score_id"))
    return rounded(st.evidence_summary(e, "split", ["e_value", "score_id"]), 4)


@query("""WITH f AS (SELECT event_type, value > 90 AS high, value < 5 AS low, event_id % 10 = 0 AS tenth FROM events), m AS (SELECT event_type, 'high' AS flag, high AS v FROM f UNION ALL SELECT event_type, 'low', low FROM f UNION ALL SELECT event_type, 'tenth', tenth FROM f)
  SELECT event_type, flag, sum(v::INT)::BIGINT AS n, round(avg(v::INT), 6) + 0.0 AS share FROM m GROUP BY 1, 2""")
def flag_counts(spark, sf_dir):
    v = F.col("value")
    return rounded(st.flag_counts(table(spark, sf_dir, "events"), ["event_type"], {"high": v > 90, "low": v < 5, "tenth": F.col("event_id") % 10 == 0}))


def _family(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("total", F.col("fl") + F.col("fs"))
    return f.select("k", "t", "fl", "fs", "price", "total", (F.col("fl") - F.col("fs")).alias("diff"), st.sc.safe_ratio("fl", "total", 0.5).alias("share"), st.sc.safe_ratio(F.col("fl") - F.col("fs"), "total", 0.0).alias("dom"),
        (F.floor("price").cast("int") % 10).alias("bin_index"), F.when(F.col("fl") > F.col("fs"), 1).otherwise(-1).alias("dominance"), F.when(F.hour("t") > 2, F.col("price")).alias("z_price"))


_FIXED = ["price_positive", "fl_not_negative", "fs_not_negative", "total_not_negative", "share_in_range", "dom_in_range", "total_is_sum", "difference_is_difference", "dominance_follows_share", "fl_finite", "fs_finite", "total_finite", "diff_finite", "dominance_allowed"]
_TRUE = {"price_positive": "price > 0", "fl_not_negative": "fl >= 0", "fs_not_negative": "fs >= 0", "total_not_negative": "fl + fs >= 0"}


@query(f"""WITH {FLOWS}, n AS (SELECT count(*)::BIGINT AS n_rows, sum((floor(price)::INT % 10 > 8)::INT)::BIGINT AS bad_bin, sum((NOT hour(t) > 2)::INT)::BIGINT AS no_z, {", ".join(f"sum((NOT ({_TRUE.get(c, 'TRUE')}))::INT)::BIGINT AS {c}" for c in _FIXED)} FROM flows),
  c AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS n_bad, n_rows, {c} = 0 AS ok FROM n" for c in _FIXED)}
    UNION ALL SELECT 'bin_index_whole_in_range', bad_bin, n_rows, bad_bin = 0 FROM n UNION ALL SELECT 'z_price_known', no_z, n_rows, no_z <= 0.5 * n_rows FROM n UNION ALL SELECT 't_known', 0, n_rows, TRUE FROM n UNION ALL SELECT 't_unique', 0, n_rows, TRUE FROM n)
  SELECT name AS "check", n_bad::BIGINT AS n_bad, n_rows, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def stage_report(spark, sf_dir):
    """The checks of the final stage over the hourly flows, among them one that fails."""
    f = _family(spark, sf_dir)
    names = ck.Family("fl", "fs", "total", "diff", "share", "dom", "price")
    return ck.run_checks(f, ck.stage_checks("final", f.columns, names)).unionByName(ck.time_checks(f, ["k"], "t"))


@query("""WITH n AS (SELECT count(*)::BIGINT AS n, sum((event_id % 50 = 0)::INT)::BIGINT AS late, sum((value < 1)::INT)::BIGINT AS neg FROM events)
  SELECT 'source_ts_not_after_ts' AS "check", late AS n_bad, n AS n_rows, CASE WHEN late = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n UNION ALL SELECT 'age_not_negative', neg, n, CASE WHEN neg = 0 THEN 'PASS' ELSE 'FAIL' END FROM n UNION ALL SELECT 'names_that_look_ahead', 1, n, 'REVIEW' FROM n""")
def leakage_report(spark, sf_dir):
    hour = F.make_dt_interval(hours=F.lit(1))
    e = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") + hour).otherwise(F.col("ts") - hour).alias("source_ts"), (F.col("value") - 1).alias("age"), F.col("value").alias("future_value"))
    return ck.leakage_report(e, "source_ts", "ts", "age")


@query("""WITH x AS (SELECT event_id % 6 AS state, CASE WHEN event_id % 6 = 1 AND event_id % 40 > 0 THEN 1 WHEN event_id % 6 = 5 AND event_id % 3 > 0 THEN -1 ELSE CASE WHEN value > 50 THEN 1 ELSE -1 END END AS d, value / 100 AS rel, CASE WHEN event_id % 4 > 0 THEN value END AS gap FROM events),
  n AS (SELECT count(*)::BIGINT AS n, sum((NOT rel BETWEEN -1e-9 AND 1 + 1e-9)::INT)::BIGINT AS r, sum((gap IS NULL)::INT)::BIGINT AS g, sum((state = 1 AND d < 0)::INT)::BIGINT AS u, sum((state = 5 AND d > 0)::INT)::BIGINT AS w, sum((state = 1)::INT)::BIGINT AS n1, sum((state = 5)::INT)::BIGINT AS n5 FROM x)
  SELECT "check", n_bad, n_rows, CASE WHEN n_bad <= share * n_rows THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'd_allowed' AS "check", 0::BIGINT AS n_bad, n AS n_rows, 0.0 AS share FROM n UNION ALL SELECT 'rel_in_range', r, n, 0.0 FROM n UNION ALL SELECT 'gap_known', g, n, 0.05 FROM n
    UNION ALL SELECT 'state_1_direction', u, n1, 0.1 FROM n UNION ALL SELECT 'state_5_direction', w, n5, 0.1 FROM n)""")
def output_sanity(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    d = F.when((i % 6 == 1) & (i % 40 > 0), 1).when((i % 6 == 5) & (i % 3 > 0), -1).otherwise(F.when(v > 50, 1).otherwise(-1))
    e = table(spark, sf_dir, "events").select((i % 6).alias("state"), d.alias("d"), (v / 100).alias("rel"), F.when(i % 4 > 0, v).alias("gap"))
    return ck.output_sanity(e, ["gap"], "d", "rel", "state", 1, 5)
