import json
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import recursive, regime, time_windows
from chronoloom.operators.asof import asof_join
from chronoloom.functions.frames import DAY, HOUR
from chronoloom.sources import readers, sinks
from chronoloom.streaming import online


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), F.col("ts").alias("t"), "value").dropDuplicates(["k", "t"])
    return e.orderBy("t")


@pytest.fixture
def stream(spark, series, tmp_path):
    """The series as a file stream of three micro-batches in order of time."""
    parts = series.withColumn("_p", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("t")))
    (tmp_path / "in").mkdir()
    for p in (1, 2, 3):
        parts.where(F.col("_p") == p).drop("_p").coalesce(1).write.parquet(str(tmp_path / f"part{p}"))
        shutil.copy(next((tmp_path / f"part{p}").glob("*.parquet")), tmp_path / "in" / f"{p}.parquet")
    return spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_online_ema_equals_batch(series, stream, tmp_path):
    got = {(r.k, r.t): r.ema for r in run(online.online_ema(stream, ["k"], "t", "value", 12), tmp_path, "s_ema").collect()}
    want = {(r.k, r.t): r.y for r in recursive.ema(series, ["k"], ["t"], "value", 12, "y").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_online_rank_equals_batch(series, stream, tmp_path):
    got = {(r.k, r.t): r["rank"] for r in run(online.online_rank(stream, ["k"], "t", "value", 2 * DAY, 10), tmp_path, "s_rank").collect()}
    want = {(r.k, r.t): r.mr for r in time_windows.past_midrank(series, ["k"], "t", "value", 2 * DAY, 10, "mr").collect()}
    none = lambda v: v is None or np.isnan(v)
    assert got.keys() == want.keys() and all((none(got[k]) and none(want[k])) or got[k] == pytest.approx(want[k]) for k in want)


def test_online_regime_equals_batch(series, stream, tmp_path):
    model = regime.Gaussians(np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[30.0], [120.0]]), np.full((2, 1), 900.0))
    got = {(r.k, r.t): (r.state, r.steady) for r in run(online.online_regime(stream, ["k"], "t", ["value"], model), tmp_path, "s_hmm").collect()}
    batch = regime.debounced(regime.forward_filter(series, ["k"], ["t"], ["value"], model), ["k"], ["t"], "state", "confidence", 2, 0.6)
    assert got == {(r.k, r.t): (r.state, r.steady) for r in batch.collect()}


def test_online_asof_equals_batch(series, stream, tmp_path):
    left = series.where("minute(t) % 2 = 0").select("k", "t")
    right = series.where("minute(t) % 2 = 1").select("k", "t", F.col("value").alias("v"))
    got = run(online.online_asof(stream.where("minute(t) % 2 = 0"), stream.where("minute(t) % 2 = 1").withColumnRenamed("value", "v"), ["k"], "t", "v", 12 * HOUR), tmp_path, "s_asof")
    want = asof_join(left, right, "t", ["k"], ["v"], tolerance=12 * HOUR)
    assert sorted((r.k, r.t) for r in got.collect()) == sorted((r.k, r.t) for r in left.collect())
    assert got.agg(F.count("matched")).first()[0] == want.agg(F.count("v")).first()[0]


def test_tumbling_bars(series, stream, tmp_path):
    bars = online.tumbling_bars(stream.withColumn("t", F.col("t").cast("timestamp")), ["k"], "t", "value")
    assert run(bars, tmp_path, "s_bars").where("high < low OR n < 1").count() == 0


def test_retrain_due(series):
    assert online.retrain_due(series, "t", None, least_rows=10)
    assert not online.retrain_due(series, "t", "2024-01-29", least_rows=10)
    assert not online.retrain_due(series, "t", None, least_rows=10**9)


def test_csv_zip_and_fallback(spark, tmp_path):
    text = "time,price\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,oops\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("__MACOSX/a.csv", "x")
        z.writestr("a.csv", text)
    schema = "time timestamp_ntz, price double"
    from_zip = readers.read_table(spark, str(tmp_path / "a.zip"), schema).collect()
    assert [(str(r.time), r.price) for r in from_zip] == [("2024-01-01 00:00:00", 1.5), ("2024-01-01 01:00:00", None)]
    assert readers.read_table(spark, f"{tmp_path}/a.zip::a.csv", schema).count() == 2
    raw = readers.first_existing(spark, [f"{tmp_path}/none.csv", f"{tmp_path}/a.csv"], "time string, price string")
    assert readers.typed_series(raw, "time", ["price"]).where("price IS NULL").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [f"{tmp_path}/none.csv"])


def test_json_series(spark, tmp_path):
    rows = [{"t": 1704067200, "v": {"o": 1, "c": "2"}}, {"t": 1704067200, "v": {"o": 3, "c": "x"}}, {"t": 1704070800, "v": {"o": 5, "c": "6"}}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    out = readers.series_from_json(readers.read_table(spark, str(tmp_path / "s.json")), fields={"o": "open", "c": "close"})
    assert out.count() == 2 and out.columns == ["ts", "open", "close"]


def test_rest_source_over_a_local_file(spark, tmp_path):
    (tmp_path / "api").write_text(json.dumps([{"t": 1, "v": 2.5}, {"t": 2, "v": None}]))
    spark.dataSource.register(readers.RestSource)
    got = spark.read.format("rest_series").option("url", f"file://{tmp_path}/api").option("schema", "t long, v double").option("rpm", "6000").load()
    assert [tuple(r) for r in got.collect()] == [(1, 2.5), (2, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.23456789), (2, None)], "t long, x double")
    path = str(tmp_path / "table")
    assert sinks.append_newer(spark, df.where("t = 1"), path, "t") == 1
    assert sinks.append_newer(spark, df, path, "t") == 1 and sinks.append_newer(spark, df, path, "t") == 0
    assert spark.read.parquet(path).count() == 2
    sinks.write_table(sinks.compact_numbers(df, 3), str(tmp_path / "out.csv"))
    assert readers.read_table(spark, str(tmp_path / "out.csv"), "t long, x double").where("x = 1.23").count() == 1
    sinks.save_parameters(spark, {"a": [1.0, 2.0]}, str(tmp_path / "model"))
    assert sinks.load_parameters(spark, str(tmp_path / "model")) == {"a": [1.0, 2.0]}
    sinks.append_history(spark, {"run": 1}, str(tmp_path / "runs"))
    sinks.append_history(spark, {"run": 2}, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
