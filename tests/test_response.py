"""Memory of responses against a row-by-row restatement; labels at their edges; paths that do not look ahead."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import response as rs
from chronoloom.plans import catalog, q_response


def test_memory_row_by_row(spark, sf_dir):
    got = {(r.k, r.t): r for r in catalog.queries()["absorption_memory"](spark, sf_dir).where("k = 'click'").collect()}
    events = q_response._events(spark, sf_dir).where("event_type = 'click'").toPandas()
    seq = events[events.horizon == "30m"].sort_values(["available_time", "event_id"]).reset_index(drop=True)
    known = []
    ewm = {(n, k): (None, 1.0) for n in ("a", "q") for k in (3, 6, 12)}
    core_time = None
    for i, e in seq.iterrows():
        core = e.context == "directional_core"
        core_time = e.available_time if core else core_time
        for k in (3, 6, 12):
            for n, x, ignore in (("a", e.absorption_score, True), ("q", e.quality_weight if core else 0.0, False)):
                y, w = ewm[n, k]
                keep = 1 - 2 / (k + 1)
                if x == x:
                    y, w = (x if y is None else (w * keep * y + (1 - keep) * x) / (w * keep + 1 - keep)), 1.0
                elif y is not None and not ignore:
                    w *= keep
                ewm[n, k] = (y, w)
        age = None if core_time is None else (e.available_time - core_time).total_seconds() / 3600
        last = lambda n, i=i: [m or "" for m in seq.market_label[max(0, i - n + 1) : i + 1]]
        known.append((e.available_time, 0.0 if age is None else 2 ** (-age / 24), {n: v[0] for n, v in ewm.items()}, sum(bool(re.search("takeover|rejection", m)) for m in last(12)), np.mean([bool(re.search("absorption|stall|rejection|takeover", m)) for m in last(6)]), e.market_label))
    curve = rs.absorption_curve(q_response._events(spark, sf_dir).where("event_type = 'click'"), ["event_type", "event_id"], []).toPandas()
    assert len(got) > 100
    for (_, t), r in got.items():
        past = [x for x in known if x[0] <= t]
        if not past:
            assert r.market_label_last is None and r.abs_score_ewm_6 is None
            continue
        _, fresh, y, takeover, absorbed, label = past[-1]
        assert r.market_label_last == label and r.takeover_count == takeover and r.absorption_persistence == pytest.approx(absorbed, abs=1e-6) and r.core_freshness == pytest.approx(fresh, abs=1e-6)
        for k in (3, 6, 12):
            assert r[f"quality_ewm_{k}"] == pytest.approx(y["q", k], abs=1e-6)
            if y["a", k] is None:
                assert r[f"abs_score_ewm_{k}"] is None and r[f"force_price_fresh_{k}"] == 0
            else:
                assert r[f"abs_score_ewm_{k}"] == pytest.approx(y["a", k], abs=1e-6) and r[f"abs_score_fresh_{k}"] == pytest.approx(50 + fresh * (y["a", k] - 50), abs=1e-5)
        ready = curve[curve.available_time <= t].sort_values("available_time")
        if len(ready):
            counts = Counter(ready.curve_label[-6:])
            assert counts[r.curve_label_mode] == max(counts.values()) and r.curve_label_last in set(ready[ready.available_time == ready.available_time.max()].curve_label)


def test_labels_at_their_edges(spark):
    c = F.col
    rows = [(None, 1.0, 1.0, 10.0, 5.0, "unavailable"), (0.9, 0.1, 1.0, 10.0, 5.0, "passive_amplification"), (0.9, -0.1, 1.0, 10.0, 5.0, "normal_response"), (0.65, 0.0, 1.0, 10.0, 5.0, "baseline_transmission"), (0.35, 0.0, 1.0, 10.0, 5.0, "normal_response"),
            (0.1, 0.0, -9.0, 10.0, 5.0, "reversal_takeover"), (0.1, 0.0, 1.0, 10.0, 5.0, "full_absorption_stall"), (0.1, 0.0, 9.0, 10.0, 5.0, "partial_absorption"), (0.3, 0.0, 1.0, None, 5.0, "partial_absorption")]
    df = spark.createDataFrame(rows, "u double, z double, y double, b double, s double, want string").withColumn("got", rs.directional_label(c("u"), c("z"), c("y"), c("b"), c("s")))
    assert all(r.got == r.want for r in df.collect())
    rows = [(None, None, 1.0, 1.0, "weak_directional_unavailable"), (0.1, 0.1, 1.0, 1.0, "weak_directional_stall_candidate"), (9.0, 1.25, 1.0, 1.0, "weak_directional_amplification_candidate"), (9.0, 1.0, None, 1.0, "weak_directional_transmission_candidate"), (-9.0, -1.0, 1.0, 1.0, "weak_directional_rejection_candidate")]
    df = spark.createDataFrame(rows, "y double, tr double, b double, s double, want string").withColumn("got", rs.weak_label(c("y"), c("tr"), c("b"), c("s")))
    assert all(r.got == r.want for r in df.collect())
    rows = [(None, "unavailable"), (0.5, "low_active_move"), (0.75, "normal_active_move"), (1.5, "strong_active_move"), (3.0, "extreme_active_move")]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "z double, want string").withColumn("got", rs.neutral_label(c("z"))).collect())
    rows = [(0, 0.9, 9.0, 9.0, "true_neutral_plie"), (None, 0.9, 9.0, 9.0, "true_neutral_plie"), (1, 0.65, 0.2, 2.0, "directional_core"), (1, 0.65, 0.2, 1.9, "weak_directional_context"), (-1, 0.1, None, None, "low_quality_plie")]
    df = spark.createDataFrame(rows, "d int, r double, n double, b double, want string").withColumn("got", rs.response_context(c("d"), c("r"), c("n"), c("b"), 2.0))
    assert all(r.got == r.want for r in df.collect())


def _hours(spark, n, late=0.0):
    rng = np.random.default_rng(2)
    x = rng.random((n, 4))
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = []
    for i in range(n):
        shift = late if i >= 200 else 0.0
        rows.append(("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(price[i] * math.exp(shift)), float(np.sign(x[i, 0] - 0.4 - shift)), float(x[i, 1]), float(x[i, 2] * 5 + shift), float(x[i, 3] * 10), float(x[i, 3] * 4 + shift)))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, price double, d double, r double, i double, b double, eff double")
    return df.withColumns({f"{c}_{h}": F.lit(0.3) for c in ("realized_vol", "trend_strength", "trend_consistency", "trend_direction", "range_compression", "jump_proxy", "price_missing_ratio", "price_gap_flag", "price_outlier_flag") for h in ("6h", "24h")})


def test_paths_and_evidence_do_not_look_ahead(spark):
    train, cut = F.col("t") < F.lit(dt.datetime(2024, 1, 6)), dt.datetime(2024, 1, 1) + dt.timedelta(hours=200)
    of = lambda late: rs.path_absorption(_hours(spark, 260, late), ["k"], "t", "price", "d", "r", "i", "b", "eff", train)
    both = [sorted(map(str, rs.state_evidence(rs.multiscale(of(late), ["k"])).where(F.col("time") < F.lit(cut)).collect())) for late in (0.0, 0.5)]
    assert len(both[0]) == 200 and both[0] == both[1]


def test_base_context(spark):
    df = _hours(spark, 120).withColumns({"severity": (F.hour("t") % 4).cast("int"), "phase": F.when(F.hour("t") % 2 == 0, "mature").when(F.hour("t") % 3 == 0, "odd"), "ret": F.col("b") - 5})
    out = rs.base_context(df, ["k"], "t", {"30m": ("ret", 1), "60m": ("ret", 2)}, "30m", F.col("t") < F.lit(dt.datetime(2024, 1, 4)), "severity", "phase", 24, 12).orderBy("t").toPandas()
    x = (df.orderBy("t").toPandas().b - 5).shift(1)
    med = x.rolling(24, min_periods=12).median()
    sigma = (1.4826 * (x - med).abs().rolling(24, min_periods=12).median()).fillna(x.expanding(5).std())
    assert out.sigma_30m.tolist() == pytest.approx(sigma.tolist(), nan_ok=True)
    q1, q2 = sigma[:72].quantile([1 / 3, 2 / 3])
    assert out.vol_regime.tolist() == ["unknown" if s != s else "low" if s <= q1 else "mid" if s <= q2 else "high" for s in sigma]
    assert set(out.phase_group) == {"mature", "other"} and set(out.severity_bucket) == {"neutral", "mild", "strong", "unknown"}
