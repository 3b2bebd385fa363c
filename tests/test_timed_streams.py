"""Streams with timers and seeds against the batch operators, with rows that arrive shuffled within the lateness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, HOUR
from chronoloom.operators import regime, stages
from chronoloom.operators.asof import asof_join
from chronoloom.streaming import timed


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timed.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


@pytest.fixture(scope="module")
def series(spark):
    """Two keys, one row about every half hour over ten days."""
    rng = np.random.default_rng(4)
    rows = [(k, int(1_704_067_200_000_000 + (i * 30 + int(rng.integers(0, 20))) * 60_000_000 + int(rng.integers(0, 1000))), float(rng.normal() ** 2 * 10), float(rng.normal() ** 2 * 8)) for k in "ab" for i in range(480)]
    return spark.createDataFrame(rows, "k string, u long, l double, s double").select("k", F.timestamp_micros("u").alias("t"), "l", "s").cache()


def shuffled(df, spark, tmp_path, name, batches, hours=3, end=True):
    """A file stream whose rows come up to ``hours`` late; a last row far ahead closes the watermark."""
    rng = np.random.default_rng(7)
    pdf = df.toPandas()
    pdf = pdf.iloc[np.argsort((pdf["t"].astype("int64") // 10**3).to_numpy() + rng.integers(0, hours * HOUR, len(pdf)))]
    folder = tmp_path / name
    folder.mkdir()
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), batches)):
        piece = spark.createDataFrame(pdf.iloc[part], df.schema)
        piece.coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        next((tmp_path / f"{name}-{k}").glob("*.parquet")).rename(folder / f"{k:03d}.parquet")
    if end:
        far = df.orderBy(F.desc("t")).limit(1).withColumns({"t": F.col("t") + F.expr("INTERVAL 100 DAYS"), "k": F.lit("end")})
        for k in (batches, batches + 1):
            far.coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
            next((tmp_path / f"{name}-{k}").glob("*.parquet")).rename(folder / f"{k:03d}.parquet")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_asof_equals_batch_under_shuffled_arrival(spark, series, tmp_path):
    left, right = series.where("s > 4").select("k", "t", "l"), series.where("s <= 4").select("k", "t", F.col("l").alias("v"), F.col("s").alias("w"))
    stream = shuffled(series, spark, tmp_path, "rows", 6)
    got = timed.asof_stream(stream.where("s > 4").select("k", "t", "l"), stream.where("s <= 4").select("k", "t", F.col("l").alias("v"), F.col("s").alias("w")), ["k"], "t", ["v", "w"], 90 * 60_000_000, "4 hours")
    got = run(got, tmp_path, "timed_asof").where("k <> 'end'")
    want = asof_join(left, right, "t", ["k"], ["v", "w"], tolerance=90 * 60_000_000)
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "t", "l", F.coalesce("v", F.lit(-1.0)), F.coalesce("w", F.lit(-1.0))).collect())
    assert rows(got) == rows(want) and got.where("v IS NULL").count() > 5


def test_each_event_matures_once(spark, series, tmp_path):
    events = series.withColumn("available", F.col("t") + F.make_dt_interval(mins=(F.col("l").cast("int") * 30 + 1)))
    out = run(timed.matured_stream(shuffled(events, spark, tmp_path, "ev", 5), ["k"], "t", "available", "4 hours"), tmp_path, "timed_matured").where("k <> 'end'")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "t", "l", "available").collect())
    assert rows(out) == rows(events)


def test_nothing_matures_before_the_watermark(spark, series, tmp_path):
    events = series.withColumn("available", F.col("t") + F.expr("INTERVAL 1 DAY"))
    out = run(timed.matured_stream(shuffled(events, spark, tmp_path, "ev", 4, end=False), ["k"], "t", "available", "4 hours"), tmp_path, "timed_early")
    newest = events.agg(F.max("t")).first()[0]
    late = out.agg(F.max("available")).first()[0]
    assert 0 < out.count() < events.count() and (newest - late).total_seconds() >= 4 * 3600


MODEL = regime.Gaussians(np.full(5, 0.2), np.full((5, 5), 0.05) + 0.75 * np.eye(5), np.array([[-1.2, -1, 0], [-0.5, -0.5, 0], [0, 0, 0], [0.5, 0.5, 0], [1.2, 1, 0]]), np.full((5, 3), 0.5))
SETTINGS = stages.ObservationSettings(3 * DAY, 20, 1e-4)


def expected(series):
    seen = stages.observation_features(series, ["k"], "t", "l", "s", SETTINGS)
    good = seen.dropna(subset=list(stages.FEATURES))
    held = regime.debounced(regime.forward_filter(good, ["k"], ["t"], stages.FEATURES, MODEL), ["k"], ["t"], "state", "confidence", 2, 0.6)
    out = {(r.k, r.t): (None, None, None) for r in seen.collect()}
    return out | {(r.k, r.t): (r.state, round(r.confidence, 8), r.steady) for r in held.collect()}


def answers(df):
    return {(r.k, r.t): (r.state, None if r.confidence is None else round(r.confidence, 8), r.steady) for r in df.where("k <> 'end'").collect()}


def test_engine_equals_batch_under_shuffled_arrival(spark, series, tmp_path):
    out = run(timed.engine(shuffled(series, spark, tmp_path, "rows", 6), ["k"], "t", "l", "s", MODEL, SETTINGS, late="4 hours"), tmp_path, "timed_engine")
    assert answers(out) == expected(series)


def test_a_seeded_engine_answers_as_one_that_saw_it_all(spark, series, tmp_path):
    cut = "2024-01-06"
    old, new = series.where(F.col("t") < cut), series.where((F.col("t") >= cut) | (F.col("k") == "b"))  # b comes again: dropped
    seed = timed.engine_seed(old, ["k"], "t", "l", "s", MODEL, SETTINGS)
    out = run(timed.engine(shuffled(new, spark, tmp_path, "rows", 4), ["k"], "t", "l", "s", MODEL, SETTINGS, late="4 hours", seed=seed), tmp_path, "timed_seeded")
    later = {(r.k, r.t) for r in series.where(F.col("t") >= cut).collect()}
    assert answers(out) == {k: v for k, v in expected(series).items() if k in later}
