"""Whole frames: the clean two-sided frame and its two inputs, the pressure chain and its labels, stored tables, exact quantiles."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import aggregates as ag, checks as ck, pressure as ps, stages as st

T0 = datetime(2024, 1, 1)


def _capped(values, factor):
    """Brute force over all rows before: capped, then filled by row number."""
    out = []
    for i, x in enumerate(values):
        seen = [v for v in values[: i + 1] if v is not None]
        if x is None or not seen:
            out.append(x)
            continue
        q1, q3 = np.quantile(seen, [0.25, 0.75])
        iqr = q3 - q1
        out.append(q3 + (factor + 1) * iqr * (x - q3) / (max(seen) - q3) if x > q3 + factor * iqr else x)
    return pd.Series(out, dtype=float).interpolate(method="linear").tolist()


def test_clean_frame_from_raw_sides(spark):
    long_side = [None, 1.0, 2.0, None, 1.5, 90.0, 1.2, -3.0, None, None]
    short_side = ["0", "2", "1", "x", "3", "0", None, "1", "0", "4"]
    rows = [("a", T0 + timedelta(hours=i), 10.0 + i, a, b, 1) for i, (a, b) in enumerate(zip(long_side, short_side, strict=True))]
    rows += [("a", T0, 99.0, 7.0, "7", 0), ("a", None, 1.0, 1.0, "1", 9)]  # an older row of the first time, a row without one
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, price double, raw_long double, raw_short string, seq int").withColumn("total_level", F.lit(-1.0))
    got = st.clean_frame(df, ["k"], "t", aliases={"at": "t"}, tie=F.col("seq"), days=30).orderBy("t").collect()
    want_l = [None if np.isnan(v) else max(v, 0.0) for v in _capped(long_side, 3.0)]
    want_s = [max(v, 0.0) for v in _capped([float(v) if v and v != "x" else None for v in short_side], 3.0)]
    assert [r.price for r in got] == [10.0 + i for i in range(10)]
    assert [r.long_level for r in got] == pytest.approx(want_l) and [r.short_level for r in got] == pytest.approx(want_s)
    assert (got[0].total_level, got[0].share, got[0].dominance_share, got[0].active) == (None, 0.5, 0.0, 0)
    for r, a, b in list(zip(got, want_l, want_s, strict=True))[1:]:
        assert (r.total_level, r.diff_level, r.active) == (pytest.approx(a + b), pytest.approx(a - b), int(a + b > 0))
        assert r.share == pytest.approx(a / (a + b) if a + b > 0 else 0.5)
    assert [r.t for r in st.clean_frame(df, ["k"], "t", aliases={"at": "t"}, start="2024-01-01 05:00:00").orderBy("t").collect()] == [T0 + timedelta(hours=i) for i in range(5, 10)]


def test_clean_frame_from_clean_sides_and_others(spark):
    df = spark.createDataFrame([("a", T0, 5.0, 900.0, 100.0), ("a", T0 + timedelta(hours=1), 5.0, 0.0, 0.0)], "k string, t timestamp_ntz, price double, long_level double, short_level double")
    got = st.clean_frame(df, ["k"], "t").orderBy("t").collect()
    assert [(r.long_level, r.share, r.dominance_share, r.active) for r in got] == [(900.0, pytest.approx(0.9), pytest.approx(0.8), 1), (0.0, 0.5, 0.0, 0)]
    ck.require_pass(ck.run_checks(st.clean_frame(df, ["k"], "t"), ck.stage_checks("clean", got[0].asDict().keys(), active="active")))
    assert st.clean_frame(df.limit(0), ["k"], "t").count() == 0
    with pytest.raises(ValueError, match="neither a raw frame"):
        st.clean_frame(df.drop("price"), ["k"], "t")


def test_pressure_missing_inputs_and_phases(spark):
    p = [f"p{i}" for i in range(1, 6)]
    rows = [("a", T0, 0.0, 10.0, 5, None, [0.0, 0.0, 0.0, 0.0, 1.0]), ("a", T0 + timedelta(hours=1), None, 10.0, 1, 180.0, [1.0, 0.0, 0.0, 0.0, 0.0]), ("a", T0 + timedelta(hours=2), -4.0, 0.0, None, 0.0, [None] * 5)]
    df = spark.createDataFrame([(*r[:6], *r[6]) for r in rows], "k string, t timestamp_ntz, fl double, fs double, state int, age double, " + ", ".join(f"{c} double" for c in p))
    a, b, c = ps.pressure_features(df, ["k"], "t", p, "fl", "fs", "state", "age").orderBy("t").collect()
    assert (a.coordinate, a.move, a.phase, a.fresh) == (pytest.approx(-0.65 + 0.35), "NA->5", "early_strong_entry", 1.0)
    assert (b.move, b.move_severity, b.strong_entry, b.direction, b.fresh) == ("5->1", -1.0, 1, 1, pytest.approx(np.exp(-2)))
    assert b.accel == pytest.approx(b.force - a.force) and a.accel == 0
    assert (c.move, c.strong, c.entered, c.coordinate, c.direction, c.phase, c.reliability) == ("1->NA", 0, 1, 0.0, 0, "neutral", 0.0)
    given = ps.pressure_features(df.withColumns({"sum": F.lit(1.0), "h": F.lit(None).cast("double"), "since": F.lit(50)}), ["k"], "t", p, "fl", "fs", "state", "age", total="sum", entropy="h", state_age="since")
    assert [r.raw_side for r in given.orderBy("t").collect()] == pytest.approx([1.0, 1.0, 0.0]) and {r.reliability for r in given.collect()} == {0.0}


def test_pressure_labels_by_hand(spark):
    base = spark.createDataFrame([("a", T0, -1), ("a", T0 + timedelta(minutes=60), 1), ("b", T0, 1)], "k string, t timestamp_ntz, direction int")
    prices = spark.createDataFrame([("a", T0, 100.0), ("a", T0 + timedelta(minutes=30), 101.0), ("a", T0 + timedelta(minutes=60), None), ("a", T0 + timedelta(minutes=90), 99.0)], "k string, t timestamp_ntz, price double")
    got = {(r.k, r.t): r for r in ps.pressure_labels(base, prices, ["k"], "t", "price", [30, 60]).collect()}
    first = got["a", T0]
    assert (first.ret_30m_bps, first.aligned_ret_30m_bps, first.ret_60m_bps) == (pytest.approx(1e4 * np.log(1.01)), pytest.approx(-1e4 * np.log(1.01)), None)
    assert got["a", T0 + timedelta(minutes=60)].ret_30m_bps is None and got["b", T0].ret_30m_bps is None


def test_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([(T0, 1.0), (T0, -2.0), (None, float("inf"))], "ts timestamp_ntz, v double")
    df.write.parquet(f"{tmp_path}/there.parquet")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "page_1.html").write_text("x")
    report = {r.check: (r.n_bad, r.status) for r in ck.artifact_checks(spark, {"a": f"{tmp_path}/there.parquet", "b": f"{tmp_path}/absent", "c": f"{tmp_path}/empty.txt"}, {"pages": (f"{tmp_path}/page_*.html", 3)}).collect()}
    assert report == {"a_exists": (0, "PASS"), "b_exists": (1, "FAIL"), "c_exists": (1, "FAIL"), "pages_count": (2, "FAIL")}
    cache = {r.check: (r.n_bad, r.status) for r in ck.cache_report(spark, f"{tmp_path}/there.parquet", [], "ts", ["v"]).collect()}
    assert cache == {"table_exists": (0, "PASS"), "ts_known": (1, "FAIL"), "ts_unique": (1, "FAIL"), "v_not_negative": (1, "FAIL"), "v_finite": (1, "FAIL")}
    assert [tuple(r) for r in ck.cache_report(spark, f"{tmp_path}/absent", [], "ts", ["v"]).collect()] == [("table_exists", 1, 1, "FAIL")]
    df.where("v > 0 AND ts IS NOT NULL").write.option("header", True).csv(f"{tmp_path}/there.csv")
    ck.require_pass(ck.cache_report(spark, f"{tmp_path}/there.csv", [], "ts", ["v"]))


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": rng.choice(["a", "b", None], 3_000, p=[0.9, 0.09, 0.01]), "x": rng.normal(0, 1e3, 3_000), "y": rng.integers(-2, 3, 3_000).astype(float)})
    frame.loc[::7, "x"] = np.nan
    frame.loc[5, "y"], frame.loc[6, "y"] = np.inf, -np.inf
    df = spark.createDataFrame(frame).withColumn("x", F.when(F.rand(1) < 0.5, F.nanvl("x", F.lit(None).cast("double"))).otherwise(F.col("x"))).withColumn("none", F.lit(None).cast("double"))
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "high": 1.0}
    got = {(r.k, r.column): r for r in ag.exact_quantiles(df, ["k"], ["x", "y", "none"], shares).collect()}
    assert set(got) == {(k, c) for k in ("a", "b", None) for c in ("x", "y")}
    for (k, c), r in got.items():
        v = frame.loc[frame.k.isna() if k is None else frame.k == k, c].dropna()
        assert (r.n, r.n_distinct) == (len(v), v.nunique())
        assert [r[n] for n in shares if n in ("q1", "mid", "q99") or c == "x"] == pytest.approx([np.quantile(v, q) for n, q in shares.items() if n in ("q1", "mid", "q99") or c == "x"])
    whole = ag.exact_quantiles(df, [], ["y"], {"mid": 0.5}).collect()
    assert [(r.n, r.mid) for r in whole] == [(3_000, frame.y.median())]
    assert ag.exact_quantiles(df.limit(0), ["k"], ["x"], shares).count() == 0
    assert [r.n_distinct for r in ag.numeric_profile(df.where("k = 'a'").select("k", "none"), ["k"], "none").collect()] == [0]
