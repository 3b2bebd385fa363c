import math

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import names
from chronoloom.operators import reviews as rv
from chronoloom.sources import sinks
from chronoloom.streaming import online


def test_inputs_with_nan_infinity_and_no_rows(spark):
    df = spark.createDataFrame([(0.5, float("inf"), "a"), (float("nan"), 1.0, None), (2.0, None, "b"), (None, 2.0, "c")], "my_quality double, level double, kind string")
    got = {r.column: r for r in rv.input_quality(df, ["my_quality", "level", "kind", "gone"]).collect()}
    assert got["my_quality"].missing_rate == 0.5 and got["my_quality"].outlier_rate == 0.25  # of all rows, as missing ones aren't outside
    assert got["level"].outlier_rate == pytest.approx(1 / 3) and got["level"].expected_range == "finite"
    assert got["kind"].missing_rate == 0.25 and got["gone"].exists is False
    empty = df.limit(0)
    assert [r.missing_rate for r in rv.input_quality(empty, ["level"]).collect()] == [None]
    assert [r.mean for r in rv.input_statistics(empty, ["level"]).collect()] == [None]
    approx = {r.column: r.p50 for r in rv.input_statistics(df, ["my_quality", "level"], 1000).collect()}
    assert approx == {"my_quality": 0.5, "level": 1.0}


def test_axis_bounds_of_constants_and_of_nothing(spark):
    df = spark.createDataFrame([("c", 50.0), ("c", 50.0), ("n", None), ("z", 0.0), ("v", 0.0), ("v", 100.0)], "k string, v double")
    got = {r.k: (r.axis_low, r.axis_high) for r in rv.axis_bounds(df, ["k"], "v").collect()}
    assert got["c"] == (45.0, 55.0) and got["n"] == (-1.0, 1.0) and got["z"] == (-1e-6, 1e-6)
    assert got["v"] == pytest.approx((0.5 - 0.08 * 99, 99.5 + 0.08 * 99))


def test_density_integrates_to_one_and_is_empty_for_a_constant(spark):
    df = spark.range(1000).select(F.sin("id").alias("v"))
    rows = rv.smoothed_density(df, "v", 50).collect()
    width = rows[1].centre - rows[0].centre
    assert len(rows) == 50 and sum(r.density for r in rows) * width == pytest.approx(1)
    assert rv.smoothed_density(df.select(F.lit(1.0).alias("v")), "v").count() == 0


def test_return_event_study_by_hand(spark):
    price = [1.0, 2.0, 4.0, None, 8.0, 16.0, 8.0, 4.0]
    df = spark.createDataFrame([("a", i, p, i in (0, 2, 5)) for i, p in enumerate(price)], "k string, t int, p double, e boolean")
    got = {r.offset: (r.median, r.n) for r in rv.return_event_study(df, ["k"], "t", "p", "e", 1, 2).collect()}
    log2 = math.log(2)  # the event of row 0 has no row before it; steps: 0, 1, 1, 0 and 0 around the gap, 1, -1, -1
    assert got == {-1: (0.0, 2), 0: (pytest.approx(log2), 2), 1: (pytest.approx((1 + 0) / 2 * log2), 2), 2: (pytest.approx((1 - 1) / 2 * log2), 2)}


def test_markers_and_pairs_leave_missing_values_out(spark):
    df = spark.createDataFrame([("a", i, None if i % 5 == 0 else float(i), float("inf") if i % 7 == 0 else 1.0) for i in range(100)], "k string, t int, x double, y double")
    assert sorted(r.t for r in rv.missing_markers(df, ["k"], "t", "x", 5).collect()) == [0, 20, 45, 70, 95]
    assert {r.t for r in rv.paired_sample(df, ["k"], "t", "x", "y", 1000).collect()} == {i for i in range(100) if i % 5 and i % 7}
    assert rv.outlier_markers(df, ["k"], "t", "x").count() == 0


def test_incremental_from_an_empty_table_is_the_whole(spark):
    b = spark.range(50).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.col("id").cast("double").alias("v"))
    build = lambda df: df.withColumn("s", F.col("v") + 1)
    assert rv.incremental(b, build(b.limit(0)), build, "t", 0).count() == 50
    assert rv.incremental(b, build(b), build, "t", 60_000_000).count() == 50


def test_monitor_falls_back_and_drives_retraining(spark):
    calibration = spark.createDataFrame([("train", 0.2, -5.0), ("validation", 0.06, 3.0)], "split string, coverage_error double, improvement double")
    assert rv.retrain_status(calibration).first().status == "watch"
    recent = spark.createDataFrame([(-0.09, 2.0)], "coverage_error double, improvement double")
    assert rv.retrain_status(calibration, recent).first().status == "retrain_now"
    assert rv.retrain_status(calibration.limit(0)).first().status == "ok"
    rows = spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 6)], "d string").select(F.to_timestamp_ntz("d").alias("t"))
    assert not online.retrain_due(rows, "t", "2024-01-02", 7, 2)
    assert online.retrain_due(rows, "t", "2024-01-02", 7, 2, status="retrain_now") and online.retrain_due(rows, "t", "2024-01-05", force=True)


def test_catalogue_is_written_as_json_and_markdown(spark, tmp_path):
    df = rv.catalogue(spark, [("b", "x", "one | two")], ["a", "b"], {})
    sinks.write_catalogue(df, str(tmp_path / "out"), ["name"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/markdown")).coalesce(1).collect()]
    assert lines == ["| name | category | description | documented | actual |", "| --- | --- | --- | --- | --- |", "| a | other | not documented | false | true |", r"| b | x | one \| two | true | true |"]
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2


def test_payload_without_rows_and_plan_time_names(spark):
    assert rv.latest_payload(spark.createDataFrame([], "t int, a int"), ["t"], ["a"]).first().payload == "{}"
    assert [names.price_suffix(b) for b in (6, 12, 24, 48)] == ["6h", "6h", "24h", "24h"]
    assert names.first_present(["r_24h", "r_6h"], ["r_12h", "r_24h"]) == "r_24h"
    with pytest.raises(ValueError):
        names.first_present(["a"], ["b"])
