"""Queries over whole tables and whole fits, against plain restatements on small fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.plans import catalog


@pytest.fixture(scope="module")
def events(sf_dir):
    return pd.read_parquet(f"{sf_dir}/events.parquet").sort_values(["ts", "event_id"])


def test_memory_of_every_event(spark, sf_dir, events):
    got = {(r.k, r.t): r.memory for r in catalog.queries()["matured_memory_whole"](spark, sf_dir).collect()}
    n = 0
    for k, e in events.groupby("event_type"):
        available, y, known = e.ts + pd.Timedelta(minutes=30), None, []
        for s in 100 * (e.event_id % 101) / 100.0:
            y = s if y is None else y + 2 / 13 * (s - y)
            known.append(y)
        for t in e.ts.dt.floor("h").unique():
            i = int((available <= t).sum()) - 1
            want = 50.0 if i < 0 else 50 + 2 ** (-(t - available.iloc[i]).total_seconds() / 3600 / 24) * (known[i] - 50)
            assert got[k, t.to_pydatetime()] == pytest.approx(want, abs=2e-6)
            n += 1
    assert n == len(got)


def test_every_event_has_a_price_row(spark, sf_dir, events):
    got = catalog.queries()["interpolated_at_all_events"](spark, sf_dir)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(events.event_id)


def test_price_lookup_keeps_odd_points_and_reads_no_frame_twice(spark):
    from chronoloom.operators import selection

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    bars = spark.createDataFrame([("a", at(1), 10.0), ("a", at(3), 30.0), ("a", at(5), None), ("b", at(1), 7.0), ("b", at(1), 7.0), ("a", None, 99.0), (None, at(1), 5.0)], "k string, t timestamp_ntz, close double")
    asked = [("a", at(0), None), ("a", at(1), 10.0), ("a", at(1, 30), 15.0), ("a", at(1, 30), 15.0), ("a", at(3), 30.0), ("a", at(4), None), ("a", at(6), None), ("b", at(1), 7.0), ("b", at(2), None), ("a", None, None), (None, at(1), None), ("c", at(1), None)]
    points = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(asked)], "id long, k string, t timestamp_ntz")
    out = selection.interpolated_at(bars, points, ["k"], "t", "close", "price")
    assert {r.id: r.price for r in out.collect()} == {i: v for i, (_, _, v) in enumerate(asked)} and out.columns == ["id", "k", "t", "price"]
    # a frame up to the end of the partition is read anew for each of its rows: 120,000 points of one key would take 7 billion steps
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "join" not in plan


def plain_quantile_fit(x, y, q=0.65, ridge=1e-4, smooth=1e-3):
    """Minimum of the smoothed loss over non-negative slopes: accelerated gradient on arrays, until it stands still."""
    sx, sy = x.std(0), y.std()
    m, t = np.column_stack([np.ones(len(x)), x / sx]), y / sy
    top = 0.5 / math.sqrt(smooth) * np.linalg.eigvalsh(m.T @ m / len(m)).max() + 2 * ridge
    z = v = np.r_[np.quantile(t, q), np.zeros(x.shape[1])]
    a = 1.0
    for _ in range(200_000):
        e = t - m @ v
        g = -m.T @ (q - 0.5 + 0.5 * e / np.sqrt(e * e + smooth)) / len(m) + 2 * ridge * np.r_[0, v[1:]]
        new = v - g / top
        new[1:] = np.maximum(new[1:], 0)
        if (new - v) @ (new - z) < 0:
            a = 1.0
        b = (1 + math.sqrt(1 + 4 * a * a)) / 2
        v, step, z, a = new + (a - 1) / b * (new - z), np.abs(new - z).max(), new, b
        if step < 1e-12:
            break
    return z[0] * sy, z[1:] * sy / sx


def test_quantile_regression_converges(spark, sf_dir):
    from chronoloom.operators import quantreg

    line = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    x, y = line[["l_quantity", "l_discount"]].to_numpy(float), line.l_extendedprice.to_numpy(float)
    a, b = plain_quantile_fit(x, y)
    got_a, got = quantreg.fit(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount"], "l_extendedprice", 0.65)
    assert got_a == pytest.approx(a, rel=1e-4) and list(got.values()) == pytest.approx(b, rel=1e-4)
    row = catalog.queries()["quantile_regression"](spark, sf_dir).first()
    assert row.n == len(line) and row.coverage == pytest.approx((y <= a + x @ b).mean(), abs=2e-3)


def test_slopes_of_the_wrong_sign_are_zero(spark):
    from chronoloom.operators import quantreg

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=400)
    a, b = plain_quantile_fit(x, y)
    got_a, got = quantreg.fit(spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["p", "q", "r", "y"])), ["p", "q", "r"], "y", 0.65)
    assert got["q"] == 0 == b[1] and got_a == pytest.approx(a, rel=1e-3) and list(got.values()) == pytest.approx(b, rel=1e-3, abs=1e-6)


def test_walk_forward_converges(spark, sf_dir):
    """All folds and targets against plain fits; jobs counted."""
    orders = pd.read_parquet(f"{sf_dir}/orders.parquet")
    x = np.column_stack([orders.o_orderdate.dt.month, orders.o_orderdate.dt.day]).astype(float)
    targets = {"price": orders.o_totalprice, "rising": orders.o_totalprice * (1 + orders.o_orderdate.dt.month / 24), "centred": orders.o_totalprice - 150000}
    spark.sparkContext.setJobGroup("folds", "")
    rows = catalog.queries()["walk_forward"](spark, sf_dir).collect()
    spark.sparkContext.setJobGroup("", "")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds"))
    assert jobs <= 40, jobs
    assert len(rows) == 3 * len({r.fold for r in rows}) and len({r.fold for r in rows}) == 20
    for r in rows:
        start, cut = pd.Timestamp(r.start), pd.Timestamp(r.cut)
        assert cut == start + pd.DateOffset(months=18)
        train = ((orders.o_orderdate >= start) & (orders.o_orderdate < cut)).to_numpy()
        test = ((orders.o_orderdate >= cut) & (orders.o_orderdate < cut + pd.DateOffset(months=3))).to_numpy()
        y = targets[r.target].to_numpy(float)
        assert r.n_train == train.sum() and r.n_test == test.sum() and not r.skipped
        if r.fold % 5 == 0:
            a, b = plain_quantile_fit(x[train], y[train])
            assert r.intercept == pytest.approx(a, rel=1e-4, abs=5) and (r.x, r.day) == pytest.approx(tuple(b), rel=1e-4, abs=0.5)
        said = np.maximum(r.intercept + x[test] @ [r.x, r.day], 0)
        off = y[test] - said
        assert (r.mean_predicted, r.mean_actual, r.positive_rate, r.coverage) == pytest.approx((said.mean(), y[test].mean(), (y[test] > 0).mean(), (y[test] <= said).mean()))
        assert r.pinball == pytest.approx(np.maximum(0.65 * off, -0.35 * off).mean())


def test_folds_and_skipped_ones(spark):
    from chronoloom.operators import quantreg

    from chronoloom.functions.names import month_folds

    assert month_folds("2020-01-31", "2022-02-01") == [("2020-01-31", "2021-07-31", "2021-10-31"), ("2020-04-30", "2021-10-30", "2022-01-30")]
    df = spark.range(60).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("t"), F.lit(5.0).alias("one"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("y"))
    a, b = quantreg.walk_forward(df, "t", [("2020-01-01", "2020-02-01", "2020-03-01"), ("2021-01-01", "2021-02-01", "2021-03-01")], ["one", "x"], "y", least_train=5)
    assert a["n_train"] == 11 and not a["skipped"] and a["x"] == pytest.approx(1, abs=0.05) and b["n_train"] == 0 and b["skipped"] and b["coverage"] is None


def plain_training(x, k, restarts=10, rounds=300):
    """The same expectation maximisation row by row on one array; the models and their likelihoods of the held-out tail."""
    cut, found = int(len(x) * 0.8), []
    y = x[:cut]

    def forward(model, z):
        start, move, m, v = model
        b = np.exp(-0.5 * (np.log(2 * np.pi * v)[None] + (z[:, None] - m[None]) ** 2 / v[None]))
        alpha, scale = np.empty((len(z), k)), np.empty(len(z))
        for t in range(len(z)):
            a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        return b, alpha, scale

    for seed in range(restarts):
        c = y[np.random.default_rng(seed).choice(cut, k, replace=False)]
        for _ in range(300):
            near = ((y[:, None] - c[None]) ** 2).argmin(1)
            c = np.array([y[near == j].mean() if (near == j).any() else c[j] for j in range(k)])
        model, last = (np.full(k, 1 / k), np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1)), c, np.full(k, y.var() + 1e-3)), -np.inf
        for _ in range(rounds):
            b, alpha, scale = forward(model, y)
            beta = np.ones((cut, k))
            for t in range(cut - 2, -1, -1):
                beta[t] = model[1] @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            g = alpha * beta
            moves = model[1] * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None])) + 10 * np.eye(k) + 0.1
            n = g.sum(0) + 1e-9
            m = g.T @ y / n
            start = g[0] + 1e-6
            model = (start / start.sum(), moves / moves.sum(1, keepdims=True), m, np.maximum(g.T @ (y * y) / n - m * m, 1e-3))
            ll = np.log(scale).sum()
            if ll - last < 1e-3:
                break
            last = ll
        found.append((np.log(forward(model, x[cut:])[2]).sum(), model))
    return max(found, key=lambda f: f[0])[1]


@pytest.mark.parametrize("block", [4096, 100])
def test_training_reads_every_row(spark, monkeypatch, block):
    from chronoloom.operators import regime

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.6, n) for m, n in ((0, 150), (2, 130), (0, 170), (5, 150), (2, 90), (5, 60))])
    monkeypatch.setattr(regime, "BLOCK", block)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(x)), "x": x}).sample(frac=1, random_state=1)).repartition(5)
    got = regime.train(df, ["x"], 3, spark, order=["t"], restarts=3)
    start, move, means, variances = plain_training(x, 3, 3)
    assert got.means.ravel() == pytest.approx(means, abs=1e-6) and got.variances.ravel() == pytest.approx(variances, abs=1e-6)
    assert got.move == pytest.approx(move, abs=1e-6) and got.start == pytest.approx(start, abs=1e-6)


def test_hmm_trained_sees_rows_beyond_the_first_two_thousand(spark):
    from chronoloom.operators import regime

    x = np.concatenate([np.random.default_rng(6).normal(m, 0.3, 1500) for m in (0, 0, 4)])  # the second regime starts at row 3000
    model, _ = regime.relabelled(regime.train(pd.DataFrame({"x": x}), ["x"], 2, spark, restarts=2), 0)
    assert model.means.ravel() == pytest.approx([0, 4], abs=0.1)


@pytest.mark.parametrize("n", [60, 90, 170, 179_460])
def test_split_takes_its_shares_as_written(spark, n):
    """In doubles, 90 * 0.7 is just below 63 and 179460 * 0.7 just below 125622."""
    from chronoloom.operators import resample

    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    got = {r.split: r["count"] for r in resample.chronological_split(df, ["k"], ["t"], 0.70, 0.15).groupBy("split").count().collect()}
    a, b = n * 70 // 100, n * 85 // 100
    assert got == {"train": a, "validation": b - a, "test": n - b}


@pytest.mark.parametrize("name", ["block_alignment", "direction_alignment"])
def test_signs_of_cancelling_returns(spark, tmp_path, name):
    """Prices of few values come back to where they were, so that sums of returns are 0 but for the last bits of the logarithms."""
    from tests import oracle

    rng = np.random.default_rng(11)
    n = 16 if name == "direction_alignment" else 800  # within 16 rows a sum has one order
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i % n), f"k{i // n}", float(rng.choice([0.0, 12.66, 29.27, 50.32, 103.67])), "{}", 1) for i in range(8000)]
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value", "props", "user_id"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    for t in set(oracle.TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    oracle.compare(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])
