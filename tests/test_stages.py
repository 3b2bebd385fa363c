import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import checks as ck, regime as rg, stages as st
from chronoloom.plans import q_stages as qs
from chronoloom.plans.registry import flows
from chronoloom.streaming import online
from tests.test_streaming_sources import run, series, stream  # noqa: F401


def midranks(rows, length, least):
    """Row by row, by definition: rows are (microseconds, value)."""
    out = []
    for i, (t, x) in enumerate(rows):
        before = [v for u, v in rows[:i] if u >= t - length]
        out.append((sum(v < x for v in before) + sum(v <= x for v in before)) / (2 * len(before)) if len(before) >= max(least, 1) else None)
    return out


def regime_by_hand(rows, s, model, confirm, switch):
    """(best, held, posteriors) of each (microseconds, long, short), None in the warm-up."""
    columns = [[(t, f(l, r)) for t, l, r in rows] for f in (lambda l, r: l / (l + r + 1e-12), lambda l, r: l - r, lambda l, r: l + r)]
    ranks = list(zip(*[midranks(c, s.lookback, s.least) for c in columns], strict=True))
    p, held, waiting, count, age, out = None, None, None, 0, 0, []
    for rank in ranks:
        if None in rank:
            out.append(None)
            continue
        z = [NormalDist().inv_cdf(min(max(q, s.clip), 1 - s.clip)) for q in rank]
        b = [math.prod(math.exp(-0.5 * (x - m) ** 2 / v) / math.sqrt(2 * math.pi * v) for x, m, v in zip(z, ms, vs, strict=True)) for ms, vs in zip(model.means, model.variances, strict=True)]
        a = [(model.start[j] if p is None else sum(p[i] * model.move[i][j] for i in range(len(b)))) * b[j] for j in range(len(b))]
        p = [x / sum(a) for x in a]
        best = int(np.argmax(p))
        held = best if held is None else held
        age += 1
        if best == held or p[best] < switch:
            waiting, count = None, 0
        else:
            count, waiting = (count + 1 if best == waiting else 1), best
            if count >= confirm and age > 1:
                held, waiting, count, age = best, None, 0, 1
        out.append((best, held, p))
    return out


def test_regime_applied_restated(spark, sf_dir):
    rows = qs.regime_applied(spark, sf_dir).orderBy("t").collect()
    last = {}
    for r in rows:
        last[r.source_t] = (r.fl, r.fs)
    source = sorted(last)
    micros = lambda t: int((t - source[0]).total_seconds() * 1e6)
    want = dict(zip(source, regime_by_hand([(micros(t), *last[t]) for t in source], qs.SETTINGS, qs.five_states(), 2, 0.6), strict=True))
    before, age, known = None, -1, 0
    for r in rows:
        w = want[r.source_t]
        if w is None:
            assert r.state is None and r.age_in_state is None and r.state_name is None
            continue
        _, held, p = w
        known += 1
        age = age + 1 if held == before else 0
        before = held
        assert r.state == held + 1 and r.age_in_state == age and r.state_name == st.ROLES[held][0] and r.state_direction == st.ROLES[held][3]
        assert [r[f"p_state_{k}"] for k in range(1, 6)] == pytest.approx(p, abs=2e-6)
        assert r.p_up == pytest.approx(p[0] + p[1], abs=2e-6) and r.dir_expect == pytest.approx(p[0] + p[1] - p[3] - p[4], abs=2e-6)
        assert r.state_confidence == pytest.approx(p[held], abs=2e-6) and r.state_entropy == pytest.approx(-sum(x * math.log(x + 1e-12) for x in p), abs=2e-6)
    assert known > 200 and len({r.state for r in rows}) > 2


def test_online_engine_equals_its_restatement(spark, stream, series, tmp_path):  # noqa: F811
    s = st.ObservationSettings(lookback=5 * 86_400_000_000, least=20)
    sides = lambda df: df.withColumns({"l": F.col("value"), "r": F.abs(F.lit(50.0) - F.col("value"))})
    got = {(r.k, r.t): (r.state, r.steady) for r in run(online.online_engine(sides(stream), ["k"], "t", "l", "r", qs.five_states(), s), tmp_path, "s_engine").collect()}
    want = {}
    batch = sides(series).collect()
    for k in {r.k for r in batch}:
        own = sorted((r for r in batch if r.k == k), key=lambda r: r.t)
        by_hand = regime_by_hand([(int((r.t - own[0].t).total_seconds() * 1e6), r.l, r.r) for r in own], s, qs.five_states(), 2, 0.6)
        want |= {(k, r.t): (None, None) if w is None else w[:2] for r, w in zip(own, by_hand, strict=True)}
    plain = {k: tuple(None if x is None or x != x else int(x) for x in v) for k, v in got.items()}
    assert plain == want and any(v[0] is not None for v in want.values())


def test_canonical_family_follows_its_levels(spark, sf_dir):
    rows = qs.canonical_family(spark, sf_dir).orderBy("t").collect()
    before, smooth, share = None, None, None
    for r in rows:
        l, s = r.long_level, r.short_level
        assert l >= 0 and s >= 0 and r.total_level == pytest.approx(l + s, abs=3e-6) and r.diff_level == pytest.approx(l - s, abs=3e-6)
        assert r.share == pytest.approx(l / (l + s) if l + s > 1e-9 else 0.5, abs=1e-5) and r.dominance_share == pytest.approx(2 * r.share - 1, abs=1e-5)
        smooth = r.diff_level if smooth is None else smooth + 2 / 17 * (r.diff_level - smooth)
        share = r.share if share is None else share + 2 / 13 * (r.share - share)
        assert r.diff_smooth == pytest.approx(smooth, abs=1e-4) and r.share_smooth == pytest.approx(share, abs=1e-5)
        if before:
            assert r.delta_long == pytest.approx(l - before[0], abs=3e-6)
        else:
            assert r.delta_long is None and r.delta_case == "None"
        before = (l, s)


def test_probits_of_columns_are_the_quantiles(spark):
    ps = [None, 0.0, 1e-5, 0.02, 0.0749, 0.3, 0.5, 0.7, 0.93, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in rg.with_probits(df, {"z": "p"}).withColumn("one", rg.probit(F.col("p"))).collect():
        want = None if r.p is None else NormalDist().inv_cdf(min(max(r.p, 1e-4), 1 - 1e-4))
        assert (r.z is None and r.one is None) if want is None else (r.z == pytest.approx(want, abs=1e-12) and r.one == pytest.approx(want, abs=1e-12))
    for r in rg.with_probits(df, {"z": "p"}, 1e-13).where("p = 0").collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(1e-13), abs=1e-9)


def test_failing_reports_raise_and_missing_columns_are_named(spark, sf_dir):
    with pytest.raises(ValueError, match="bin_index_whole_in_range"):
        ck.require_pass(qs.stage_report(spark, sf_dir))
    with pytest.raises(ValueError, match="missing columns: bin_index"):
        ck.stage_checks("model", ["price", "share"])
    f = flows(spark, sf_dir)
    ck.require_pass(ck.time_checks(f, ["k"], "t"))
    twice = {r.check: r.n_bad for r in ck.time_checks(f.limit(3).unionByName(f.limit(3)), ["k"], "t").collect()}
    assert twice == {"t_known": 0, "t_unique": 3}
    skipped = {r.check: r.status for r in ck.leakage_report(f.select("t", "price"), "source_ts", "t", "age").collect()}
    assert skipped == {"source_ts_not_after_t": "SKIP", "age_not_negative": "SKIP", "names_that_look_ahead": "PASS"}


def test_empty_frames_have_reports(spark):
    empty = spark.createDataFrame([], "k string, t timestamp_ntz, v double")
    assert {r.status for r in ck.time_checks(empty, ["k"], "t").collect()} == {"PASS"}
    assert st.flag_counts(empty, ["k"], {"a": F.col("v") > 0}).count() == 0 and st.evidence_summary(empty, "k", ["v"]).count() == 0
