"""Densities, outliers, order of states, retraining with swap, the ZIP sink."""

import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import aggregates as ag, checks as ck, regime as rg, scans
from chronoloom.sources import readers, versions, zips
from chronoloom.streaming import retraining


def test_density_against_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 60_000), rng.normal(6, 0.3, 39_990), rng.normal(0, 400, 10)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x})).unionByName(spark.createDataFrame([("few", 1.0), ("few", 2.0), ("flat", 5.0)] + [("flat", 5.0)] * 9 + [("a", None)], "k string, v double"))
    got = ag.kernel_density(df, ["k"], "v").orderBy("point").toPandas()
    assert set(got.k) == {"a"} and len(got) == 220
    bw = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    want = np.array([np.exp(-0.5 * ((g - x) / bw) ** 2).mean() / (bw * np.sqrt(2 * np.pi)) for g in got.x])
    assert np.abs(got.density - want).max() < 0.01 * want.max() and (np.abs(got.density / want - 1) < 0.01).all()
    assert got.x.iloc[0] == pytest.approx(np.quantile(x, 0.005)) and got.x.iloc[-1] == pytest.approx(np.quantile(x, 0.995))


def test_outliers_by_hand(spark):
    values = [1.0, 2.0, 1.5, 1.2, None, 1.8, 1.1, 1.9, 40.0, 1.3, 1.6, 1.4]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("flat", i, 3.0) for i in range(4)] + [("none", 0, None)], "k string, t int, v double")
    marks = ck.outlier_marks(df, ["k"], "t", "v", ck.OutlierLimits(2.5, 3.0, (0.0, 1.0), 10.0, 20.0)).cache()
    by = {r.t: r for r in marks.where("k = 'a'").collect()}
    assert 4 not in by and len(by) == 11
    assert (by[8].zscore, by[8].iqr, by[8].explosion, by[8].cliff) == (True, True, True, True) and by[9].cliff and not by[9].zscore
    assert not by[5].cliff  # the row before has no value: no step
    counts = {r.k: r for r in ck.outlier_counts(marks, ["k"]).collect()}
    assert counts["a"].n_zscore == 1 and counts["a"].n_cliff == 2 and counts["flat"].n_iqr == counts["flat"].n_cliff == 0 and "none" not in counts
    worst = ck.outlier_examples(marks, ["k"], "t", "v", 1).collect()
    assert [(r.k, r.place, r.t, r.reason) for r in worst] == [("a", 1, 8, "zscore,iqr,explosion,cliff")]


def test_posteriors_follow_the_order_of_states(spark):
    rng = np.random.default_rng(1)
    lean = np.array([0.1, 3.0, -4.0, 1.0, -1.5])  # short less long of each state; 0.1 is neutral
    s = rng.integers(0, 5, 500)
    pdf = pd.DataFrame({"k": 1, "t": range(500), "x": s * 3.0 + rng.normal(0, 0.2, 500), "l": 10.0 - lean[s] / 2, "s": 10.0 + lean[s] / 2})
    df = spark.createDataFrame(pdf)
    model = rg.Gaussians(np.full(5, 0.2), np.full((5, 5), 0.1) + 0.5 * np.eye(5), np.arange(5)[:, None] * 3.0, np.full((5, 1), 0.3))
    before = rg.forward_filter(df, ["k"], ["t"], ["x"], model)
    new, order = rg.relabelled_by_medians(model, before, "state", "l", "s")
    assert order == [1, 3, 0, 4, 2]
    after = rg.forward_filter(df, ["k"], ["t"], ["x"], new).orderBy("t").toPandas()
    before = before.orderBy("t").toPandas()
    for j, old in enumerate(order):
        assert np.allclose(after[f"p{j}"], before[f"p{old}"])
    assert (np.array(order)[after.state] == before.state).all()
    found = {r.state: r for r in rg.neutral_first(rg.pressure_medians(spark.createDataFrame(before), "state", "l", "s")).collect()}
    assert all(r.sign_ok for r in found.values()) and sum(r.share for r in found.values()) == pytest.approx(1) and found[0].new_state == 3


def test_warm_start_swap_and_failures(spark, tmp_path):
    rng = np.random.default_rng(2)
    path = str(tmp_path / "model")
    s = np.repeat(rng.integers(0, 2, 60), 20)
    history = spark.createDataFrame(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=len(s), freq="h"), "x": s * 4.0 + rng.normal(0, 0.5, len(s)), "l": 5.0 - s, "s": 5.0 + s})).withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert retraining.served(spark, path) == (0, None)
    first = retraining.retrain(spark, history, path, ["x"], ["t"], 2, ("l", "s"), restarts=2)
    assert (first.status, first.version) == ("trained", 1)
    version, model = retraining.served(spark, path)
    assert version == 1 and sorted(model.means.ravel().round(0).tolist()) == [0.0, 4.0]
    # a fit that fails leaves the served model
    kept = retraining.retrain(spark, history.limit(1), path, ["x"], ["t"], 2)
    assert kept.status == "kept" and kept.version == 1 and "too few" in kept.error and retraining.served(spark, path)[0] == 1
    wrong = retraining.retrain(spark, history, path, ["x"], ["t"], 3)
    assert wrong.status == "kept" and "start from" in wrong.error
    # from the served parameters: few rounds, the same states in the same places
    second = retraining.retrain(spark, history, path, ["x"], ["t"], 2, rounds=5)
    assert second.version == 2 and np.allclose(retraining.served(spark, path)[1].means, model.means, atol=0.05)
    cold = rg.train(history, ["x"], 2, spark, ["t"], restarts=1)
    assert sorted(cold.means.ravel()) == pytest.approx(sorted(retraining.served(spark, path)[1].means.ravel()), abs=0.05)


def test_retraining_after_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    path = str(tmp_path / "model")
    s = np.repeat(rng.integers(0, 2, 40), 12)
    rows = spark.createDataFrame(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=len(s), freq="h"), "x": s * 4.0 + rng.normal(0, 0.5, len(s))})).withColumn("t", F.col("t").cast("timestamp_ntz")).cache()
    seen = {"until": "2024-01-05"}
    each = retraining.retraining(path, lambda: rows.where(F.col("t") < F.lit(seen["until"])), "t", ["x"], ["t"], 2, days=7, least_rows=50, restarts=1)
    assert [each(rows, 0).status, each(rows, 1).status] == ["trained", "not_due"]
    seen["until"] = "2024-01-09"
    assert each(rows, 2).status == "not_due"
    seen["until"] = "2024-01-15"
    assert (each(rows, 3).version, versions.current(spark, path)) == (2, 2)


def test_zip_sink(spark, tmp_path):
    zips.register(spark)
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit('say "hi", '), F.col("id").cast("string"), F.lit("\nä")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"), (F.col("id") % 2 == 0).alias("b"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t")).repartition(4)
    folder = str(tmp_path / "out")
    os.makedirs(folder)
    df.write.format("zip_csv").option("name", "features").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["features.zip"]
    with zipfile.ZipFile(f"{folder}/features.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 4 and z.namelist()[0] == "features-00000.csv"
    plain = df.drop("text")
    plain.write.format("zip_csv").option("name", "plain").mode("append").save(folder)
    back = readers.read_table(spark, f"{folder}/plain.zip::*", "id long, x double, b boolean, t timestamp_ntz")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    frames = pd.concat(pd.read_csv(zipfile.ZipFile(f"{folder}/features.zip").open(n)) for n in zipfile.ZipFile(f"{folder}/features.zip").namelist())
    assert sorted(frames.text) == sorted(r.text for r in df.collect())
    spark.range(0).write.format("zip_csv").option("name", "empty").mode("append").save(folder)
    assert zipfile.ZipFile(f"{folder}/empty.zip").read("empty-00000.csv") == b"id\r\n"


def test_zip_sink_leaves_nothing_after_a_failed_task(spark, tmp_path):
    zips.register(spark)
    folder = str(tmp_path / "out")
    os.makedirs(folder)
    good = spark.range(10).repartition(3)
    good.write.format("zip_csv").mode("append").save(folder)
    with pytest.raises(Exception, match="no more"):
        spark.range(40).repartition(3).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no more"))).otherwise(F.col("id")).alias("id")).write.format("zip_csv").mode("overwrite").save(folder)
    assert os.listdir(folder) == ["table.zip"] and len(pd.concat(pd.read_csv(zipfile.ZipFile(f"{folder}/table.zip").open(n)) for n in zipfile.ZipFile(f"{folder}/table.zip").namelist())) == 10


def test_slope_that_updates_its_first_row_in_chunks(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("a", i, None if i < 3 or rng.random() < 0.1 else float(rng.normal())) for i in range(200)], "k string, t int, x double")
    part = [scans.Slope(["x"], ["s"], 1e-3, 1e-4, 0.1, True)]
    one, many = (scans.scan(rows, ["k"], ["t"], part, chunk=c).orderBy("t").toPandas() for c in (None, 17))
    assert np.allclose(one.s, many.s, equal_nan=True, atol=1e-10) and one.s.iloc[:3].isna().all() and one.s.iloc[3] == 0
