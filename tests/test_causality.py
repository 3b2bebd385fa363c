"""Nothing before a cut may move when rows after it change; edge fixtures for the ordered operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import DAY, HOUR
from chronoloom.operators import asof, islands, ranks, recursive as rc, regime, time_windows as tw, windows as wn

T0, N, CUT = dt.datetime(2024, 1, 1), 160, 100


def frame(spark, factor=1.0):
    rng = np.random.default_rng(5)
    x = 100 + np.cumsum(rng.normal(0, 1, N))
    rows = [("a", T0 + dt.timedelta(hours=i), float(x[i] * (factor if i >= CUT else 1)), int(rng.integers(-1, 2)) if i < CUT else int(factor) % 3 - 1, float(rng.random())) for i in range(N)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, x double, s int, p double")


MODEL = regime.Gaussians(np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[95.0], [105.0]]), np.full((2, 1), 9.0))
K = ["k"]
OPERATORS = {
    "rolling_quantile": lambda d: ranks.rolling_quantiles(d, K, "t", "x", {"o": 0.4}, least=4, rows=12),
    "nested_mad_z": lambda d: wn.nested_mad_z(d, K, "t", "x", 12, 6, "o"),
    "true_mad_z": lambda d: wn.true_mad_z(d, K, "t", "x", 12, 6, "o"),
    "matured_sigma": lambda d: wn.matured_sigma(d, K, "t", "x", 3, 24, 12, 6, "o"),
    "slope": lambda d: d.withColumn("o", wn.rolling_slope(F.col("x"), K, "t", 5)),
    "bins": lambda d: ranks.expanding_bins(d, K, "t", "x", 5, 24, 12, 2, "o"),
    "entries": lambda d: islands.entry_counter(d, K, "t", "s", "o"),
    "run": lambda d: islands.run_length(d, K, "t", "s", "o"),
    "trend": lambda d: tw.rolling_trend(d, K, "t", "x", DAY, "o").withColumnRenamed("o_slope", "o"),
    "jump": lambda d: tw.jump_features(tw.base_returns(d, K, "t", "x"), K, "t", "ret", "p", DAY, 2.0, "o").withColumnRenamed("o_proxy", "o"),
    "midrank": lambda d: tw.past_midrank(d, K, "t", "x", DAY, 5, "o"),
    "percentile": lambda d: tw.past_percentile(d, K, "t", "x", DAY, 5, "o"),
    "iqr_z": lambda d: tw.iqr_z(d, K, "t", "x", DAY, 5, "o"),
    "cap": lambda d: tw.outlier_cap(d, K, "t", "x", DAY, "o"),
    "ema": lambda d: rc.ema(d, K, ["t"], "x", 8, "o"),
    "kalman": lambda d: rc.kalman_level(d, K, ["t"], "x", "o"),
    "local_slope": lambda d: rc.local_slope(d, K, ["t"], "x", "o"),
    "kama": lambda d: rc.kama(d, K, "t", "x", 8, "o"),
    "fir": lambda d: d.withColumn("o", rc.gaussian_fir(F.col("x"), K, "t", 9)),
    "wavelet": lambda d: rc.trailing_wavelet(d, K, ["t"], "x", 64, 2, "o"),
    "hmm": lambda d: regime.forward_filter(d, K, ["t"], ["x"], MODEL).withColumnRenamed("p0", "o"),
    "viterbi": lambda d: regime.prefix_viterbi(d, K, ["t"], ["x"], MODEL, "o"),
    "anchor": lambda d: d.withColumn("o", asof.anchor(d, K, "t", "x", 3 * HOUR, HOUR)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_before_the_cut_do_not_move(spark, name):
    cut = T0 + dt.timedelta(hours=CUT)
    before = [sorted((r.t, r.o) for r in OPERATORS[name](frame(spark, f)).where(F.col("t") < F.lit(cut)).select("t", "o").collect()) for f in (1.0, 2.0)]
    assert len(before[0]) == CUT
    for (t, a), (u, b) in zip(*before, strict=True):
        assert t == u and (a == b or (a is None) == (b is None) and (np.isnan(a) and np.isnan(b) or a == pytest.approx(b, abs=1e-12)))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_single_and_null_rows(spark, name):
    full = frame(spark)
    for df, n in ((full.limit(0), 0), (full.limit(1), 1), (full.limit(6).withColumn("x", F.lit(None).cast("double")), 6)):
        assert OPERATORS[name](df).count() == n


def test_asof_tolerance_is_inclusive_and_ties_take_the_last(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2)), ("a", T0 + dt.timedelta(hours=2, microseconds=1)), ("b", T0)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0, 1, 1.0), ("a", T0, 2, 2.0), ("b", T0 + dt.timedelta(hours=1), 1, 9.0)], "k string, t timestamp_ntz, seq long, v double")
    got = sorted((r.k, r.t, r.v) for r in asof.asof_join(left, right, "t", K, ["v"], tolerance=2 * HOUR, tie="seq").collect())
    assert [v for _, _, v in got] == [2.0, None, None]
    late = asof.asof_join(left, right, "t", K, ["v"], offset=2 * HOUR, tie="seq").collect()
    assert sorted(r.v or 0 for r in late) == [0, 2.0, 2.0]
    assert {r.v for r in asof.asof_join(left.limit(1), left.limit(1).withColumn("v", F.lit(1)), "t", K, ["v"], strict=True).collect()} == {None}


def test_left_edge_of_a_time_span_is_open(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=1), 2.0)], "k string, t timestamp_ntz, x double")
    got = {r.t.hour: r.rv for r in df.select("t", tw.realised_volatility(F.col("x"), K, "t", HOUR).alias("rv")).collect()}
    assert got == {0: 1.0, 1: 2.0}


def test_scalars(spark):
    row = spark.range(1).select(
        sc.finite(F.lit(float("nan"))).alias("a"), sc.number(F.lit("x1")).alias("b"), sc.clip(F.lit(None).cast("double"), 0.0).alias("c"), sc.divide(F.lit(1.0), F.lit(0.0)).alias("d"),
        sc.safe_ratio(F.lit(1.0), F.lit(0.0), 0.5).alias("e"), sc.log_return_bps(F.lit(0.0), F.lit(1.0)).alias("f"), sc.slug(F.lit(" A b/C! ")).alias("g"), sc.transition(F.lit(None).cast("int"), F.lit(3)).alias("h"),
        sc.row_margin(F.lit(1.0), F.lit(4.0), F.lit(None)).alias("i"), sc.row_argmax(["p", "q"], [F.lit(2.0), F.lit(2.0)]).alias("j"), regime.probit(F.lit(0.5)).alias("k"),
        sc.last_assignment(F.lit(0), (F.lit(True), F.lit(1)), (F.lit(True), F.lit(2))).alias("l"),
    ).first()
    assert tuple(row) == (None, None, None, None, 0.5, None, "a-b-c", "NA->3", 3.0, "p", 0.0, 2)


def test_training_finds_two_regimes(spark):
    rng = np.random.default_rng(0)
    import pandas as pd

    x = np.concatenate([rng.normal(m, 0.5, 60) for m in (0, 5, 0, 5)])
    model, _ = regime.relabelled(regime.train(pd.DataFrame({"x": x}), ["x"], 2, spark, restarts=3), 0)
    assert model.means.ravel() == pytest.approx([0, 5], abs=0.5) and (model.move.diagonal() > 0.8).all()
