"""Order statistics of sliding frames against plain restatements, whole and in chunks; the wavelet and the normal quantile."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, HOUR
from chronoloom.operators import ranks, recursive as rc, regime, time_windows as tw, windows as wn

T0, K = dt.datetime(2024, 1, 1), ["k"]


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(4)
    hours = np.sort(rng.choice(700, 400, replace=False))
    x = np.where(rng.random(400) < 0.1, np.nan, np.round(rng.normal(0, 1, 400), 1))  # ties and missing values
    pdf = pd.DataFrame({"k": "a", "t": [T0 + dt.timedelta(hours=int(h)) for h in hours], "x": x})
    return pdf, spark.createDataFrame([("a", t.to_pydatetime(), None if v != v else float(v)) for t, v in zip(pdf.t, pdf.x, strict=True)], "k string, t timestamp_ntz, x double").repartition(5)


def close(df, column, want):
    got = [r[column] for r in df.orderBy("t").collect()]
    assert [g is None for g in got] == [w != w for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w == w], abs=1e-9)


def test_sorted_blocks(monkeypatch):
    monkeypatch.setattr(ranks.Sorted, "SIZE", 4)
    rng, s, plain = np.random.default_rng(0), ranks.Sorted(), []
    for _ in range(2000):
        if plain and rng.random() < 0.45:
            x = plain.pop(int(rng.integers(len(plain))))
            s.remove(x)
        else:
            x = float(rng.integers(0, 60))
            s.add(x)
            plain.append(x)
        plain.sort()
        y = float(rng.integers(-1, 61))
        assert len(s) == len(plain) and s.below(y) == sum(v < y for v in plain) and s.upto(y) == sum(v <= y for v in plain)
        if plain:
            assert s.quantile(0.37) == pytest.approx(np.quantile(plain, 0.37))


@pytest.mark.parametrize("cut", [{}, {"chunk": 50, "buckets": 40 * HOUR}])
def test_quantiles_over_rows(gappy, cut):
    pdf, df = gappy
    out = ranks.rolling_quantiles(df, K, "t", "x", {"a": 0.2, "b": 0.5}, least=10, rows=30, **cut)
    assert out.columns == ["k", "t", "x", "a", "b"]
    close(out, "a", pdf.x.rolling(30, min_periods=10).quantile(0.2).tolist())
    close(out, "b", pdf.x.rolling(30, min_periods=10).quantile(0.5).tolist())


@pytest.mark.parametrize("chunk", [None, 5 * DAY])
def test_frames_over_time(gappy, chunk):
    pdf, df = gappy
    s = pdf.set_index("t").x
    close(ranks.rolling_quantiles(df, K, "t", "x", {"a": 0.7}, least=5, length=2 * DAY, chunk=chunk), "a", s.rolling("2D", min_periods=5).quantile(0.7).tolist())
    roll = s.rolling("2D", min_periods=8)
    close(tw.past_percentile(df, K, "t", "x", 2 * DAY, 8, "o"), "o", ((roll.rank() - 1) / (s.rolling("2D").count() - 1)).tolist())
    before = [s[(s.index >= t - pd.Timedelta(days=2)) & (s.index < t)].dropna() for t in s.index]
    close(tw.past_midrank(df, K, "t", "x", 2 * DAY, 8, "o"), "o", [((b < v).sum() + (b <= v).sum()) / (2 * len(b)) if v == v and len(b) >= 8 else np.nan for v, b in zip(s, before, strict=True)])
    h = s.shift(1).rolling("3D", min_periods=6)
    z = ((s - h.median()) / (h.quantile(0.75) - h.quantile(0.25) + 1e-12)).clip(-5, 5)
    both = ranks.span_context(df, K, "t", 3 * DAY, 6, {"r": "x"}, {"z": "x"})
    close(both, "z", z.tolist())
    close(both, "r", ((s.rolling("3D", min_periods=6).rank() - 1) / (s.rolling("3D").count() - 1)).tolist())
    close(tw.train_or_past_z(df, K, "t", "x", None, 3 * DAY, 6, "z"), "z", z.tolist())


def test_z_by_training_rows(gappy):
    pdf, df = gappy
    train = pdf[pdf.t < T0 + dt.timedelta(days=9)].x
    want = ((pdf.x - train.median()) / (train.quantile(0.75) - train.quantile(0.25) + 1e-12)).clip(-5, 5)
    close(tw.train_or_past_z(df, K, "t", "x", F.col("t") < F.lit(T0 + dt.timedelta(days=9)), 3 * DAY, 6, "z"), "z", want.tolist())


def test_nested_and_past_sigma(gappy):
    pdf, df = gappy
    med = pdf.x.rolling(20, min_periods=8).median()
    mad = (pdf.x - med).abs().rolling(20, min_periods=8).median()
    z = (pdf.x - med) / (1.4826 * mad)
    close(wn.nested_mad_z(df, K, "t", "x", 20, 8, "z"), "z", z.where(mad != 0).tolist())
    s = pdf.set_index("t").x.shift(1)
    m = s.rolling(20, min_periods=15).median()
    scale = 1.4826 * (s - m).abs().rolling(20, min_periods=15).median()
    wide = (s.rolling("4D", min_periods=15).quantile(0.75) - s.rolling("4D", min_periods=15).quantile(0.25)) / 1.349
    close(wn.past_sigma(df, K, "t", "x", 20, 15, 4 * DAY, "o"), "o", scale.fillna(wide).clip(lower=1e-12).tolist())


def test_row_numbers_by_buckets(gappy):
    assert [r.n for r in ranks.numbered(gappy[1], K, "t", 30 * HOUR, "n").orderBy("t").collect()] == list(range(400))


@pytest.mark.parametrize(("history", "level"), [(64, 2), (200, 3), (301, 3)])
def test_wavelet_by_the_whole_transform(spark, history, level):
    x = 5 + np.cumsum(np.random.default_rng(3).normal(0, 0.2, 420))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    got = [r.o for r in rc.trailing_wavelet(df, K, ["t"], "x", history, level, "o").orderBy("t").collect()]
    for i in range(40, 420, 7):
        assert got[i] == pytest.approx(max(rc.wavelet_end(x[max(i - history, 0) : i], level), 0), rel=1e-9)


def test_wavelet_at_full_parameters():
    """17,280 values and level 6: the tail that is read gives what the whole history gives."""
    rng = np.random.default_rng(1)
    x = np.abs(np.cumsum(rng.normal(0, 1, 17280 + 40)))
    for n in (17280, 17283, 17311):
        tail = rc.wavelet_reach(6) + n % 64
        assert rc.wavelet_end(x[:n][-tail:], 6) == pytest.approx(rc.wavelet_end(x[:n], 6), rel=1e-12)


def test_wavelet_keeps_a_constant():
    assert rc.wavelet_end(np.full(200, 3.5), 3) == pytest.approx(3.5)


def test_probit(spark):
    p = [1e-9, 1e-4, 0.001, 0.02, 0.075, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-6]
    rows = spark.createDataFrame([(v,) for v in p], "p double").select(regime.probit(F.col("p"), 1e-12).alias("z")).collect()
    assert [r.z for r in rows] == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-14)
    assert spark.range(1).select(regime.probit(F.lit(0.0))).first()[0] == pytest.approx(NormalDist().inv_cdf(1e-4))


def test_a_missing_value_only_predicts(spark):
    model = regime.Gaussians(np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.0], [10.0]]), np.ones((2, 1)))
    df = spark.createDataFrame([("a", i, None if i == 1 else 10.0) for i in range(6)], "k string, t int, x double")
    out = regime.prefix_viterbi(regime.forward_filter(df, K, ["t"], ["x"], model), K, ["t"], ["x"], model).orderBy("t").collect()
    assert [r.state for r in out] == [1] * 6 == [r.viterbi for r in out]
