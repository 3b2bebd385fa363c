"""Online versions of the ordered operators: state per key, event time, late rows dropped, one stateful hop each.

Rows of a micro-batch are sorted by event time before they are applied; rows not later than the last one seen are dropped, as
in the batch operators after de-duplication. State is a few numbers (or a bounded list) per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.functions.scalar import EPS
from chronoloom.operators.ranks import Frame, midrank
from chronoloom.operators.regime import Gaussians
from chronoloom.operators.stages import ObservationSettings


def _fresh(pdfs: Iterator[pd.DataFrame], ts: str, last: float) -> pd.DataFrame:
    rows = pd.concat(list(pdfs)).sort_values(ts, kind="stable")
    at = rows[ts].astype("datetime64[us]").astype("int64")
    keep = (at > last) & ~at.duplicated(keep="last")
    return rows[keep].assign(_at=at[keep])


def online_ema(stream: DataFrame, keys: Sequence[str], ts: str, value: str, span: float) -> DataFrame:
    """(keys, ts, value, ema) of each accepted row."""
    alpha = 2 / (span + 1)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y, last = state.get if state.exists else (None, -(2**62))
        rows = _fresh(pdfs, ts, last)
        out = []
        for x in rows[value].to_numpy(float):
            if x == x:
                y = x if y is None else y + alpha * (x - y)
            out.append(y)
        if len(rows):
            state.update((y, int(rows["_at"].iloc[-1])))
        yield rows.assign(ema=out)[[*keys, ts, value, "ema"]]

    schema = ", ".join(f"`{c}` {dict(stream.dtypes)[c]}" for c in (*keys, ts, value)) + ", ema double"
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "y double, last long", "append", GroupStateTimeout.NoTimeout)


def online_rank(stream: DataFrame, keys: Sequence[str], ts: str, value: str, lookback: int, least: int) -> DataFrame:
    """Mid-rank of each value among those of [t - lookback, t), NULL until there are enough; older ones leave the state."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last = state.get if state.exists else ([], [], -(2**62))
        times, values = list(times), list(values)
        rows = _fresh(pdfs, ts, last)
        out = []
        for at, x in zip(rows["_at"].to_numpy(), rows[value].to_numpy(float), strict=True):
            cut = int(np.searchsorted(times, at - lookback))
            times, values = times[cut:], values[cut:]
            v = np.array(values)
            out.append(((v < x).sum() + (v <= x).sum()) / (2 * len(v)) if x == x and len(v) >= max(least, 1) else None)
            if x == x:  # a NULL has no rank and is no one's past
                times.append(int(at))
                values.append(float(x))
        if len(rows):
            state.update((times, values, int(rows["_at"].iloc[-1])))
        yield rows.assign(rank=pd.Series(out, index=rows.index, dtype=float))[[*keys, ts, value, "rank"]]

    schema = ", ".join(f"`{c}` {dict(stream.dtypes)[c]}" for c in (*keys, ts, value)) + ", rank double"
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "times array<long>, seen array<double>, last long", "append", GroupStateTimeout.NoTimeout)


class _Regime:
    """The filter and the debounced state of one key, row by row."""

    schema = "a array<double>, current int, waiting int, n int, age int"

    def __init__(self, model: Gaussians, confirm: int, switch: float, held: tuple | None) -> None:
        self.log_start, self.log_move = np.log(model.start + 1e-300), np.log(model.move + 1e-300)
        self.confirm, self.switch = confirm, switch
        a, self.current, self.waiting, self.count, self.age = held or (None, None, None, 0, 0)
        self.a = None if a is None else np.array(a)

    def take(self, density: np.ndarray) -> tuple[int, float, int]:
        """Best state, its probability, and the state held."""
        if self.a is None:
            a = self.log_start + density
        else:
            m = self.a[:, None] + self.log_move
            top = m.max(0)
            a = top + np.log(np.exp(m - top).sum(0)) + density
        self.a = a = a - (a.max() + np.log(np.exp(a - a.max()).sum()))
        s, p = int(a.argmax()), float(np.exp(a.max()))
        self.current = s if self.current is None else self.current
        self.age += 1
        if s == self.current or p < self.switch:
            self.waiting, self.count = None, 0
        else:
            self.count = self.count + 1 if s == self.waiting else 1
            self.waiting = s
            if self.count >= self.confirm and self.age > 1:
                self.current, self.waiting, self.count, self.age = s, None, 0, 1
        return s, p, self.current

    def held(self) -> tuple:
        return (None if self.a is None else self.a.tolist(), self.current, self.waiting, self.count, self.age)


def online_regime(stream: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str], model: Gaussians, confirm: int = 2, switch: float = 0.6) -> DataFrame:
    """Filtered best state, its probability, and the debounced state of each accepted row; a row with a NULL feature only predicts."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, last = state.get if state.exists else (None, None, None, 0, 0, -(2**62))
        own, rows = _Regime(model, confirm, switch, tuple(held)), _fresh(pdfs, ts, last)
        done = [own.take(d) for d in model.known_density(rows[list(features)].to_numpy(float))]
        if len(rows):
            state.update((*own.held(), int(rows["_at"].iloc[-1])))
        best, sure, steady = zip(*done, strict=True) if done else ((), (), ())
        yield rows.assign(state=list(best), confidence=list(sure), steady=list(steady))[[*keys, ts, "state", "confidence", "steady"]]

    schema = ", ".join(f"`{c}` {dict(stream.dtypes)[c]}" for c in (*keys, ts)) + ", state int, confidence double, steady int"
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, _Regime.schema + ", last long", "append", GroupStateTimeout.NoTimeout)


def online_engine(
    stream: DataFrame, keys: Sequence[str], ts: str, long_side: str, short_side: str, model: Gaussians, s: ObservationSettings = ObservationSettings(), confirm: int = 2, switch: float = 0.6
) -> DataFrame:
    """From two sides to the regime in one stateful hop: ranks of share, difference and total, their normal scores, filter, debounce.

    The state of a key is its last ``lookback`` of values and the filter. Until there are enough values a row has no state; all
    three ranks take every row in, as in ``stages.observation_features``, whose average over both sides (``span``) has no online form here.
    """
    if s.span:
        raise ValueError("online_engine takes unsmoothed sides; put online_ema before it")
    normal = NormalDist()

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, longs, shorts, *held, last = state.get if state.exists else ([], [], [], None, None, None, 0, 0, -(2**62))
        own, rows = _Regime(model, confirm, switch, tuple(held)), _fresh(pdfs, ts, last)
        frames = [Frame(s.lookback + 1) for _ in range(3)]

        def ranks(at: int, l: float, r: float) -> list[float]:
            return [midrank(f, at, x, s.least) for f, x in zip(frames, (l / (l + r + EPS), l - r, l + r), strict=True)]

        for known in zip(times, longs, shorts, strict=True):
            ranks(*known)
        times, longs, shorts, out = list(times), list(longs), list(shorts), []
        for at, l, r in zip(rows["_at"].tolist(), rows[long_side].to_numpy(float).tolist(), rows[short_side].to_numpy(float).tolist(), strict=True):
            found = ranks(at, l, r)
            times.append(at)
            longs.append(l)
            shorts.append(r)
            if any(p != p for p in found):
                out.append((None, None, None))
                continue
            z = np.array([[normal.inv_cdf(min(max(p, s.clip), 1 - s.clip)) for p in found]])
            out.append(own.take(model.log_density(z)[0]))
        if len(rows):
            end = int(rows["_at"].iloc[-1])
            cut = int(np.searchsorted(times, end - s.lookback))
            state.update((times[cut:], longs[cut:], shorts[cut:], *own.held(), end))
        best, sure, steady = zip(*out, strict=True) if out else ((), (), ())
        done = rows.assign(state=pd.array(best, "Int32"), confidence=pd.array(sure, "Float64"), steady=pd.array(steady, "Int32"))
        yield done[[*keys, ts, "state", "confidence", "steady"]]

    schema = ", ".join(f"`{c}` {dict(stream.dtypes)[c]}" for c in (*keys, ts)) + ", state int, confidence double, steady int"
    kept = "times array<long>, longs array<double>, shorts array<double>, " + _Regime.schema + ", last long"
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)


def online_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, tolerance: int) -> DataFrame:
    """Each left row with the key's latest right value seen at or before its time, at most ``tolerance`` microseconds old.

    Both streams go through one stateful hop; a micro-batch is applied in order of time, right rows first.
    """
    names = [*keys, ts]
    both = left.select(*names, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_side")).unionByName(right.select(*names, value, F.lit(0).alias("_side")))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(pdfs))
        rows = rows.assign(_at=rows[ts].astype("datetime64[us]").astype("int64")).sort_values(["_at", "_side"], kind="stable")
        out = []
        for side, x, now in zip(rows["_side"], rows[value], rows["_at"], strict=True):
            if side == 0:
                held, at = (float(x), int(now)) if at is None or now >= at else (held, at)
            out.append(held if at is not None and 0 <= now - at <= tolerance else None)
        if at is not None:
            state.update((held, at))
        done = rows.assign(matched=pd.Series(out, index=rows.index, dtype=float))
        yield done[done["_side"] == 1][[*names, "matched"]]

    schema = ", ".join(f"`{c}` {dict(left.dtypes)[c]}" for c in names) + ", matched double"
    return both.groupBy(*keys).applyInPandasWithState(step, schema, "held double, at long", "append", GroupStateTimeout.NoTimeout)


def tumbling_bars(stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of an event-time window, closed by a watermark. ``ts`` must be a timestamp."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("t"), "low", "high", "total", "n")


def matured(events: DataFrame, clock: DataFrame, available: str, ts: str) -> DataFrame:
    """Events that are available at each clock time of one micro-batch: use inside ``foreachBatch``."""
    now = clock.agg(F.max(ts).alias("_now"))
    return events.crossJoin(F.broadcast(now)).where(F.col(available) <= F.col("_now")).drop("_now")


def retrain_due(history: DataFrame, ts: str, last_trained: str | None, days: int = 7, least_rows: int = 144, status: str | None = None, force: bool = False) -> bool:
    """Whether to train now: forced, or enough rows and either no model yet, a monitor that says ``retrain_now`` (``reviews.retrain_status``) or enough time since the last training."""
    if force:
        return True
    fresh = history if last_trained is None else history.where(F.col(ts) > F.lit(last_trained).cast("timestamp_ntz"))
    row = fresh.agg(F.count("*").alias("n"), F.max(ts).alias("hi")).first()
    if row.n < least_rows:
        return False
    return last_trained is None or status == "retrain_now" or (pd.Timestamp(row.hi) - pd.Timestamp(last_trained)).days >= days
