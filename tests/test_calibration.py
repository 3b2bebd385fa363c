"""Shares of training values by bucket: against brute force, ranges of values, and the plan's exchanges."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators import aggregates as ag
from chronoloom.plans import catalog


def test_levels_by_brute_force(spark):
    rng = np.random.default_rng(5)
    values = [None, 0.0, -0.0, 1.0, 1.0, 2.0, 0.5, -1.5, 1e-300, -1e300, float("inf"), *rng.normal(0, 3, 60).round(1).tolist()]
    rows = [(i, str(rng.choice(list("ab"))) if i % 7 else None, int(rng.integers(3)), values[int(rng.integers(len(values)))], bool(rng.random() < 0.6), bool(rng.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, p string, q int, v double, train boolean, side boolean").withColumn("m", F.create_map(F.lit("a"), "i"))
    levels, others, least = [["p", "q"], ["q"], []], [["p"], []], 45
    got = {r.i: r.u for r in ag.hierarchical_cdf(df, levels, "v", F.col("train"), least, "u", F.col("side"), others).collect()}
    assert len(got) == len(rows)
    at = {"p": 1, "q": 2}
    for i, *_, v, _, side in rows:
        want = None
        if v is not None:
            own = others if side else levels
            for k, level in enumerate(own):
                known = [r[3] for r in rows if r[4] and r[5] == side and r[3] is not None and all(r[at[c]] == rows[i][at[c]] for c in level)]
                if len(known) >= least or k == len(own) - 1:
                    want = sum(x <= v for x in known) / len(known) if known else None
                    break
        assert got[i] == (None if want is None else pytest.approx(want, abs=1e-12)), rows[i]


def test_without_training_rows_or_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 2.0)], "i int, k string, v double")
    assert {r.i: r.u for r in ag.empirical_cdf(df, ["k"], "v", F.lit(False)).collect()} == {1: None, 2: None, 3: None}
    assert {r.i: r.u for r in ag.empirical_cdf(df, ["k"], "v", F.lit(True)).collect()} == {1: 1.0, 2: None, 3: 1.0}
    assert ag.empirical_cdf(df.limit(0), ["k"], "v", F.lit(True)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=40))
def test_ranges_never_fall(spark, values):
    values = sorted({*values, *[math.nextafter(2.0**k, d) for k in (-1074, -3, 0, 1, 10, 1023) for d in (0, math.inf)], *[-(2.0**k) for k in (-3, 0, 10)], 5e-324})
    found = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", ag.value_range(F.col("v")).alias("r")).orderBy("v").collect()]
    assert found == sorted(found)
    assert spark.range(1000).select(ag.value_range(1000 + F.col("id")).alias("r")).distinct().count() >= 250


def test_one_count_and_one_lookup_for_all_levels(spark, sf_dir):
    df = catalog.queries()["absorption_events"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    done = [line for line in plan.split("\n") if not re.search("ReusedExchange", line)]
    assert sum("FileScan" in line for line in done) <= 3
    assert sum(bool(re.search(r"(Broadcast)?Exchange ", line)) for line in done) <= 12
