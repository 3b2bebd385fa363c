"""Recurrences in chunks and from a table of states: equal to one pass over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import recursive as rc, regime as rg, scans
from chronoloom.sources import versions

MODEL = rg.Gaussians(np.array([0.2, 0.3, 0.5]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.02, 0.08, 0.9]]), np.array([[-1.0], [0.0], [1.5]]), np.array([[0.4], [0.5], [0.6]]))
PARTS = [
    scans.Average(["x"], ["ema"], 0.15), scans.Average(["x"], ["ema_decaying"], 0.15, False), scans.Level(["x"], ["level"]), scans.Slope(["x"], ["slope"]),
    scans.Adaptive(["x", "w"], ["kama"]), rg.filter_of(["x"], MODEL), scans.RunLength(["s"], ["run"]),
]
OUTPUTS = [c for p in PARTS for c in p.outputs]


def series(n, seed=0, key="a"):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n).cumsum() / 5)
    x[: n // 12] = np.nan  # no value at first
    x[n // 2 : n // 2 + n // 6] = np.nan  # longer than a chunk
    s = np.repeat(rng.integers(0, 3, n), rng.integers(1, 60))[:n].astype(float)
    s[n // 3 : n // 3 + 5] = np.nan
    return pd.DataFrame({"k": key, "t": pd.date_range("2024-01-01", periods=n, freq="h") if key != "b" else pd.date_range("2020-06-01", periods=n, freq="min"), "x": x, "w": np.where(rng.random(n) < 0.1, np.nan, rng.random(n)), "s": s})


@pytest.fixture(scope="module")
def rows(spark):
    pdf = pd.concat([series(700), series(300, 1, "b"), series(40, 2, None), series(1, 3, "d")])
    return spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xws"}).withColumn("t", F.col("t").cast("timestamp_ntz")).repartition(6).cache()


def table(df, columns=OUTPUTS):
    pdf = df.toPandas()
    pdf["k"] = pdf["k"].fillna("-")
    return pdf.sort_values(["k", "t"]).reset_index(drop=True)[["k", "t", *columns]]


def equal(a, b, columns=OUTPUTS):
    pd.testing.assert_frame_equal(table(a, columns), table(b, columns), check_exact=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("hours", [1, 7, 24, 400, 100_000])
def test_chunks_of_any_width(rows, hours):
    equal(scans.scan(rows, ["k"], ["t"], PARTS, chunk=hours * 3_600_000_000), scans.scan(rows, ["k"], ["t"], PARTS))


def test_all_in_one_pass_is_one_after_the_other(rows):
    one = rows
    for p in PARTS:
        one = scans.scan(one, ["k"], ["t"], [p])
    equal(one, scans.scan(rows, ["k"], ["t"], PARTS))


def test_scan_over_an_earlier_output(rows):
    both = [scans.Level(["x"], ["level"]), scans.Average(["level"], ["smooth"], 0.2)]
    equal(scans.scan(rows, ["k"], ["t"], both), rc.ema(rc.kalman_level(rows, ["k"], ["t"], "x", "level"), ["k"], ["t"], "level", 9, "smooth"), ["level", "smooth"])
    with pytest.raises(ValueError, match="one after the other"):
        scans.scan(rows, ["k"], ["t"], both, chunk=10**9)


@pytest.mark.parametrize("chunk", [None, 30 * 3_600_000_000])
def test_going_on_from_states(rows, chunk):
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    old, new = rows.where(F.col("t") < cut), rows.where(F.col("t") >= cut)
    states = scans.last_states(old, ["k"], ["t"], PARTS, chunk=chunk)
    both = scans.scan(old, ["k"], ["t"], PARTS, chunk=chunk).unionByName(scans.scan(new, ["k"], ["t"], PARTS, chunk=chunk, states=states))
    equal(both, scans.scan(rows, ["k"], ["t"], PARTS))
    after = {r.k: r for r in scans.last_states(new, ["k"], ["t"], PARTS, states=states).collect()}
    assert set(after) == {"a", "b", None, "d"} and after["b"].t == max(r.t for r in rows.where("k = 'b'").collect())  # keys without new rows keep theirs


def test_ten_appends_are_one_build(spark, rows, tmp_path):
    steady = [rg.filter_of(["x"], MODEL), scans.Debounce(["state", "confidence"], ["steady"], 2, 0.6, 3)]
    own = ["ema", "ema_decaying", "level", "slope", "kama", "run"]
    several = [p for p in PARTS if not isinstance(p, scans.Filter)]
    days = [r[0] for r in rows.select(F.to_date("t")).distinct().orderBy(F.to_date("t")).collect()]
    pieces = np.array_split(np.array(days), 10)
    for name, parts, columns in (("plain", several, own), ("regime", steady, ["p0", "p1", "p2", "state", "steady"])):
        path = str(tmp_path / name)
        for k, piece in enumerate(pieces):
            part = rows.where(F.to_date("t").between(F.lit(str(piece[0])).cast("date"), F.lit(str(piece[-1])).cast("date")))
            assert versions.append_scan(spark, part, path, ["k"], ["t"], parts) == k + 1
            assert versions.append_scan(spark, part, path, ["k"], ["t"], parts) == k + 1  # all of it is there
        equal(versions.read_rows(spark, path), scans.scan(rows, ["k"], ["t"], parts), columns)


def test_an_attempt_that_fails_changes_nothing(spark, rows, tmp_path, monkeypatch):
    path, parts = str(tmp_path / "t"), [scans.Average(["x"], ["ema"], 0.15)]
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    versions.append_scan(spark, rows.where(F.col("t") < cut), path, ["k"], ["t"], parts)
    before = versions.read_rows(spark, path).count()
    monkeypatch.setattr(scans, "last_states", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        versions.append_scan(spark, rows, path, ["k"], ["t"], parts)
    assert versions.current(spark, path) == 1 and versions.read_rows(spark, path).count() == before
    monkeypatch.undo()
    assert versions.append_scan(spark, rows, path, ["k"], ["t"], parts) == 2
    equal(versions.read_rows(spark, path), scans.scan(rows, ["k"], ["t"], parts), ["ema"])
    with pytest.raises(ValueError, match="not newer"):
        versions.publish(spark, path, 2)


def test_debounce_without_a_state(spark):
    rows = [(i, s, p) for i, (s, p) in enumerate([(None, None), (None, 0.9), (1, 0.9), (None, 0.9), (2, 0.9), (None, 0.9), (2, 0.9), (2, 0.9), (2, 0.2), (1, 0.9)])]
    df = spark.createDataFrame(rows, "t int, s int, p double").withColumn("k", F.lit(1))
    got = [r.steady for r in rg.debounced(df, ["k"], ["t"], "s", "p", 2, 0.6).orderBy("t").collect()]
    assert got == [None, None, 1, 1, 1, 1, 1, 2, 2, 2]


def test_empty_and_null_order(spark, rows):
    assert scans.scan(rows.limit(0), ["k"], ["t"], PARTS, chunk=10**9).count() == 0
    odd = rows.where("k = 'a'").limit(50).withColumn("t", F.when(F.col("x") > 0, F.col("t")))
    assert scans.scan(odd, ["k"], ["t"], PARTS[:1], chunk=10**9).count() == 50


def test_wavelet_weights_are_the_transform():
    rng = np.random.default_rng(0)
    for level in (1, 3, 6):
        for n in (1, 5, 17, 18, 40, 333, 2400):
            x = rng.normal(size=n)
            assert rc.wavelet_weights(n, level) @ x == pytest.approx(rc.wavelet_end(x, level), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_tails_hold_what_a_look_back_sees(spark, batch):
    """At each mark the last rows and averages are those of a scan over all rows; the other rows are left out but for a few of each chunk."""
    rng = np.random.default_rng(9)
    rows = [(str(k) if k else None, int(t), i, None if rng.random() < 0.3 else float(v)) for i, (k, t, v) in enumerate(zip(rng.integers(0, 3, 3000), rng.integers(0, 5_000_000, 3000) // 1000 * 1000, rng.normal(size=3000), strict=True))]
    rows.append(("1", None, 3000, 50.0))
    df = spark.createDataFrame(rows, "k string, at long, i long, x double").select("k", F.timestamp_micros("at").cast("timestamp_ntz").alias("t"), "i", "x")
    marks = spark.createDataFrame([(k, t) for k in (None, "1", "2") for t in (0, 70_000, 70_001, 1_500_000, 1_999_999, 2_000_000, 4_100_000)], "k string, at long").select("k", F.timestamp_micros("at").cast("timestamp_ntz").alias("m"))
    parts = [scans.Average(["x"], ["a"], 0.3), scans.Average(["x"], ["b"], 0.2, False), scans.Average(["x"], ["last"], 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        every = scans.scan(df, ["k"], ["t", "i"], parts).toPandas().sort_values(["t", "i"], na_position="first")
        tails = scans.tails(df, ["k"], ["t", "i"], parts, 4, marks, "m", 1_000_000).toPandas().sort_values(["t", "i"], na_position="first")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = 0
    for k, m in marks.toPandas().itertuples(index=False):
        a, b = (d[(d.k.isna() if k is None else d.k == k) & (d.t.isna() | (d.t <= m))] for d in (every, tails))
        assert a.i.tolist()[-4:] == b.i.tolist()[-4:]
        if len(a):
            assert b.iloc[-1][["a", "b", "last"]].tolist() == pytest.approx(a.iloc[-1][["a", "b", "last"]].tolist(), abs=1e-9, nan_ok=True)
            seen += 1
    assert seen >= 18 and (batch == "7" or len(tails) <= 4 * 3 * (7 + 6))
