"""Pressure features, matured memory and the score model: compositions of the window and join operators.

All thresholds are parameters of frozen settings; decisions are CASE chains, labels that look ahead are made only where the
name says so. Every function takes the partition keys first and works for many entities at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import scalar as sc
from chronoloom.functions.frames import HOUR, Keys, at_least, ordered, rows
from chronoloom.operators import windows as wn
from chronoloom.operators.asof import asof_join
from chronoloom.operators.islands import run_length
from chronoloom.operators.recursive import ema


#: How much a change of state strengthens (or turns) the pressure; other changes count 0.
MOVE_SEVERITY = {"2->1": 1.0, "4->5": 1.0, "3->1": 0.7, "3->5": 0.7, "1->2": 0.3, "5->4": 0.3, "1->5": -1.0, "5->1": -1.0}


@dataclass(frozen=True)
class PressureSettings:
    posterior_weight: float = 0.65
    state_weights: tuple[float, ...] = (1.0, 0.5, 0.0, -0.5, -1.0)
    dead_zone: float = 0.03
    z_rows: int = 24
    z_least: int = 8
    strong_states: tuple[int, ...] = (1, 5)
    age_free: float = 60.0
    age_scale: float = 60.0
    usual_rows: int = 24
    usual_least: int = 3
    mature_rows: int = 24


def pressure_features(
    df: DataFrame, keys: Keys, ts: str, posteriors: Sequence[str], long_side: str, short_side: str, state: str, age_minutes: str, s: PressureSettings = PressureSettings(),
    *, total: str | None = None, entropy: str | None = None, state_age: str | None = None,
) -> DataFrame:
    """The pressure of two opposed sides and its phase, from what is known at each row.

    ``posteriors`` are the state probabilities from the strongest upward state to the strongest downward one. Adds ``raw_side`` (balance of
    the sides), ``severity`` (weighted probabilities), their blend ``coordinate`` and its ``direction``; ``z_total`` (robust z of the log total),
    ``intensity``, ``force``, ``accel`` (growth of the force along the direction); ``move``, ``move_severity``, ``strong``, ``entered``,
    ``strong_entry``; ``base_reliability``, ``fresh``, ``reliability``; ``phase``; and ``log_intensity``, ``log_accel`` for a score model.

    Missing or negative sides count 0, as do missing probabilities and ages; a missing entropy is the largest one. Without a column
    of its own the total is the sum of the sides (it is never below that), the entropy that of the probabilities, and the state's age the rows since it was entered.
    """
    c, w = F.col, ordered(keys, ts)
    side = lambda n: F.coalesce(sc.clip(F.col(n).cast("double"), 0.0), F.lit(0.0))
    p = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in posteriors]
    both = side(long_side) + side(short_side)
    df = df.withColumn("_total", both if total is None else F.greatest(sc.clip(F.col(total).cast("double"), 0.0), both))
    df = df.withColumns({
        "raw_side": (side(short_side) - side(long_side)) / (c("_total") + sc.EPS),
        "severity": sum((F.lit(v) * x for v, x in zip(s.state_weights, p, strict=True)), F.lit(0.0)), "_log": F.log1p("_total"),
    })
    df = df.withColumn("coordinate", s.posterior_weight * c("severity") + (1 - s.posterior_weight) * c("raw_side"))
    df = wn.true_mad(df.withColumn("_med", F.percentile("_log", 0.5).over(rows(keys, ts, s.z_rows))), keys, ts, "_log", s.z_rows, s.z_least, "_mad")
    df = df.withColumns({
        "z_total": F.coalesce((c("_log") - c("_med")) / (wn.MAD_SCALE * c("_mad") + sc.EPS), F.lit(0.0)),
        "direction": F.when(F.abs("coordinate") < s.dead_zone, 0).otherwise(F.signum("coordinate").cast("int")),
    })
    df = df.withColumns({"intensity": F.abs("coordinate") * sc.softplus("z_total"), "force": c("coordinate") * sc.softplus("z_total")})
    before = F.lag(state).over(w)
    df = df.withColumns({
        "accel": F.greatest(c("direction") * F.coalesce(c("force") - F.lag("force").over(w), F.lit(0.0)), F.lit(0.0)),
        "move": sc.transition(before, c(state)),
        "strong": F.coalesce(c(state).isin(*s.strong_states), F.lit(False)).cast("int"),
        "entered": F.when(c(state) == before, 0).otherwise(1),
    })
    severity = F.create_map(*[F.lit(x) for pair in MOVE_SEVERITY.items() for x in pair])
    h = sc.entropy(p, normalised=False) if entropy is None else F.col(entropy)
    df = df.withColumns({
        "move_severity": F.coalesce(F.try_element_at(severity, c("move")), F.lit(0.0)), "strong_entry": c("strong") * c("entered"),
        "base_reliability": sc.clip(F.abs("coordinate"), 0.0, 1.0) * F.coalesce(sc.clip(1 - h / log(len(posteriors)), 0.0, 1.0), F.lit(0.0)),
        "fresh": sc.freshness(F.coalesce(age_minutes, F.lit(0.0)), s.age_free, s.age_scale),
    })
    df = df.withColumn("reliability", c("base_reliability") * c("fresh"))
    df = run_length(df, keys, ts, state, "_age") if state_age is None else df.withColumn("_age", F.coalesce(state_age, F.lit(0)))
    recent = rows(keys, ts, s.usual_rows)
    df = df.withColumn("_usual", F.coalesce(at_least(F.percentile("accel", 0.5).over(recent), c("accel"), recent, s.usual_least), F.lit(0.0)))
    phase = (
        F.when(c("direction") == 0, "neutral").when(c("strong_entry") == 1, "early_strong_entry")
        .when(c("accel") > c("_usual"), "accelerating").when(c("_age") >= s.mature_rows, "mature").otherwise("normal")
    )
    return df.withColumns({"phase": phase, "log_intensity": F.log1p("intensity"), "log_accel": F.log1p("accel")}).drop("_total", "_log", "_med", "_mad", "_age", "_usual")


def pressure_labels(df: DataFrame, prices: DataFrame, keys: Keys, ts: str, price: str, minutes: Sequence[int], direction: str = "direction") -> DataFrame:
    """Labels, look ahead: ``ret_{m}m_bps``, the log return of the price from a row's time to exactly ``m`` minutes later, and
    ``aligned_ret_{m}m_bps``, the same along the direction; NULL where one of the prices is missing. One join serves all horizons. Of several
    prices of one time the smallest counts."""
    spans = [0, *minutes]
    placed = prices.where(F.col(price).isNotNull()).select(*keys, F.col(price).alias("_p"), F.posexplode(F.array(*[F.col(ts) - F.make_dt_interval(mins=F.lit(m)) for m in spans])).alias("_i", ts))
    known = placed.groupBy(*keys, ts).agg(*[F.min(F.when(F.col("_i") == i, F.col("_p"))).alias(f"_p{i}") for i in range(len(spans))])
    out = df.join(known, [*keys, ts], "left")
    out = out.withColumns({f"ret_{m}m_bps": sc.log_return_bps(f"_p{i}", "_p0") for i, m in enumerate(spans) if i})
    return out.withColumns({f"aligned_ret_{m}m_bps": F.col(direction) * F.col(f"ret_{m}m_bps") for m in minutes}).drop(*[f"_p{i}" for i in range(len(spans))])


def matured_memory(base: DataFrame, events: DataFrame, keys: Keys, ts: str, available: str, score: str, span: float, half_life_hours: float, out: str = "memory", tie: Sequence[str] = ()) -> DataFrame:
    """Exponential memory of event scores that were available at each time, pulled to 50 as the last one ages.

    Events of one time are taken in the order of ``tie``, and the last of them is what stands at that time.
    """
    remembered = ema(events.where(F.col(available).isNotNull()), keys, [available, *tie], score, span, "_ewm")
    if tie:
        remembered = remembered.groupBy(*keys, available).agg(F.max_by("_ewm", F.struct(*tie)).alias("_ewm"))
    right = remembered.select(*keys, F.col(available).alias(ts), F.col("_ewm"))
    joined = asof_join(base, right, ts, keys, ["_ewm"], age="_age")
    f = sc.half_life(F.col("_age") / HOUR, half_life_hours)
    return joined.withColumns({f"{out}_raw": F.col("_ewm"), f"{out}_age_h": F.col("_age") / HOUR, out: 50 + f * (F.coalesce("_ewm", F.lit(50.0)) - 50)}).drop("_ewm", "_age")


def score_model(features: dict[str, float], intercept: float, reliability: Column, direction: Column) -> tuple[Column, Column]:
    """(expected size, signed expectation) of a linear model with non-negative size: literal coefficients over columns."""
    size = sc.clip(F.lit(intercept) + sum((F.lit(b) * F.col(n) for n, b in features.items()), F.lit(0.0)), 0.0)
    return size, size * reliability * direction
