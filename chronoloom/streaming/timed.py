"""Stateful operators with event-time timers, expiring state and an initial state from a batch frame (``transformWithState``).

Input rows go through one stateful hop by key; the stream needs a watermark on its time column, and answers leave when the watermark has
passed them, so they don't depend on the order of arrival within the lateness. Set ``spark.sql.streaming.stateStore.providerClass`` to
the RocksDB provider (``use_rocksdb``): only what a key's rows touch is read and written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from chronoloom.functions.frames import DAY
from chronoloom.functions.scalar import EPS, micros
from chronoloom.operators import scans, stages
from chronoloom.operators.ranks import Frame, midrank
from chronoloom.operators.regime import Gaussians

#: Rows travel through the state as JSON with all microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(times: pd.Series) -> np.ndarray:
    return times.dt.tz_localize(None).astype("datetime64[us]").astype("int64").to_numpy() if getattr(times.dt, "tz", None) is not None else times.astype("datetime64[us]").astype("int64").to_numpy()


def _schema(df: DataFrame, columns: Sequence[str]) -> StructType:
    return StructType([df.schema[c] for c in columns])


class _Waiting(StatefulProcessor):
    """Rows wait in a list of their key until the watermark has passed their ``due_`` (microseconds); a timer stands at the earliest."""

    def __init__(self, kept: StructType) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kept)

    def take(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.waiting.appendList(list(rows[self.kept.names].itertuples(index=False, name=None)))
            self.handle.registerTimer(int(rows["due_"].min() // 1000) + 1)

    def ready(self, watermark_ms: int) -> pd.DataFrame:
        """Rows that are due; the others stay, and the timer with the earliest of them."""
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.kept.names) if self.waiting.exists() else pd.DataFrame(columns=self.kept.names)
        due = rows["due_"].astype("int64") <= watermark_ms * 1000
        rest = rows[~due]
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
            self.handle.registerTimer(int(rest["due_"].min() // 1000) + 1)
        else:
            self.waiting.clear()
        return rows[due]

    def close(self) -> None:
        pass


class _Matured(_Waiting):
    def __init__(self, kept: StructType, keys: list[str]) -> None:
        super().__init__(kept)
        self.keys = keys

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            self.take(pdf)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        done = self.ready(timerValues.getCurrentWatermarkInMs())
        if len(done):
            yield done.sort_values("due_", kind="stable").assign(**dict(zip(self.keys, key, strict=True)))[[*self.keys, "at_", "rest_"]]


def matured_stream(events: DataFrame, keys: Sequence[str], ts: str, available: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, when the watermark (``late`` behind the newest ``ts``) has passed its time of availability; never before.

    ``ts`` must be a timestamp; rows later than the watermark are dropped on arrival."""
    columns = events.columns
    timed = events.withWatermark(ts, late).withColumn("due_", micros(available))
    text = timed.select(*keys, ts, "due_", F.to_json(F.struct(*[c for c in columns if c not in (*keys, ts)]), _JSON).alias("rest_"))
    kept = StructType.fromDDL("at_ long, due_ long, rest_ string")
    rows = text.withColumn("at_", micros(ts))
    out = rows.groupBy(*keys).transformWithStateInPandas(
        _Matured(kept, list(keys)), StructType([*_schema(rows, keys).fields, *StructType.fromDDL("at_ long, rest_ string").fields]), "Append", "EventTime"
    )
    rest = StructType([events.schema[c] for c in columns if c not in (*keys, ts)])
    return out.withColumn(ts, F.timestamp_micros("at_")).withColumn("r_", F.from_json("rest_", rest, _JSON)).select(*[F.col(c) if c in (*keys, ts) else F.col(f"r_.{c}").alias(c) for c in columns])


class _Asof(_Waiting):
    """Left rows wait; right rows are an ordered buffer, cut at the newest one that a later left row can still match."""

    def __init__(self, keys: list[str], tolerance: int) -> None:
        super().__init__(StructType.fromDDL("due_ long, id_ string"))
        self.keys, self.tolerance, self.buffer = keys, tolerance, StructType.fromDDL("at long, v string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rights = handle.getListState("rights", self.buffer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            left = pdf[pdf["side_"] == 1]
            self.take(left.assign(id_=left["v_"]))
            right = pdf[pdf["side_"] == 0]
            if len(right):
                self.rights.appendList([(int(a), v) for a, v in zip(right["due_"], right["v_"], strict=True)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        left = self.ready(now).sort_values("due_", kind="stable")
        held = sorted(((int(a), v) for a, v in self.rights.get()), key=lambda r: (r[0], r[1] or "")) if self.rights.exists() else []
        times = np.array([a for a, _ in held], np.int64)
        due = left["due_"].astype("int64").to_numpy()
        at = np.searchsorted(times, due, "right") - 1
        found = [held[k][1] if k >= 0 and t - times[k] <= self.tolerance else None for k, t in zip(at.tolist(), due.tolist(), strict=True)]
        first = max(int(np.searchsorted(times, now * 1000, "right")) - 1, 0)  # all before it are too old for whatever comes
        if first:
            self.rights.put(held[first:])
        if len(left):
            yield pd.DataFrame({**{k: [v] * len(left) for k, v in zip(self.keys, key, strict=True)}, "left_": left["id_"].to_list(), "right_": found})


def asof_stream(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], tolerance: int, late: str = "10 minutes") -> DataFrame:
    """Each left row once with the key's latest right row at or before its time, at most ``tolerance`` microseconds older: the columns of the batch
    as-of join, whatever the order of arrival within ``late``. Of right rows of one time the last by their values stands.

    Left rows leave when the watermark (``late`` behind the newest ``ts`` of both streams) has passed them; what is later is dropped."""
    text = lambda df, cols: F.to_json(F.struct(*cols), _JSON | {"ignoreNullFields": "false"})
    own = [c for c in left.columns if c not in keys]
    a = left.select(*keys, ts, F.lit(1).alias("side_"), text(left, own).alias("v_"))
    b = right.select(*keys, ts, F.lit(0).alias("side_"), text(right, list(columns)).alias("v_"))
    both = a.unionByName(b).withWatermark(ts, late).withColumn("due_", micros(ts))
    schema = StructType([*_schema(a, keys).fields, *StructType.fromDDL("left_ string, right_ string").fields])
    out = both.groupBy(*keys).transformWithStateInPandas(_Asof(list(keys), tolerance), schema, "Append", "EventTime")
    l, r = StructType([left.schema[c] for c in own]), StructType([right.schema[c] for c in columns])
    out = out.withColumns({"l_": F.from_json("left_", l, _JSON), "r_": F.from_json("right_", r, _JSON)})
    return out.select(*keys, *[F.col(f"l_.{c}").alias(c) for c in own], *[F.col(f"r_.{c}").alias(c) for c in columns])


class _Engine(StatefulProcessor):
    """Values of the lookback by day, the filter and the debounced state; rows wait for the watermark, so late ones come in their place."""

    def __init__(self, keys: list[str], model: Gaussians, s: stages.ObservationSettings, confirm: int, switch: float) -> None:
        self.keys, self.s, self.parts = keys, s, stages.regime_parts(model, confirm, switch)
        self.schemas = [StructType.fromDDL(x) for x in ("day long", "at array<long>, l array<double>, r array<double>", "filter array<double>, steady array<double>, last long", "at long, l double, r double")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        day, values, held, row = self.schemas
        self.handle = handle
        self.days = handle.getMapState("days", day, values)
        self.held = handle.getValueState("held", held)
        self.waiting = handle.getListState("waiting", row)

    def _add(self, rows: list[tuple[int, float, float]]) -> None:
        by_day: dict[int, list[tuple[int, float, float]]] = {}
        for row in rows:
            by_day.setdefault(row[0] // DAY, []).append(row)
        for day, new in by_day.items():
            old = self.days.getValue((day,)) if self.days.containsKey((day,)) else ((), (), ())
            self.days.updateValue((day,), tuple([*a, *b] for a, b in zip(old, zip(*new, strict=True), strict=True)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        for row in initialState.itertuples(index=False):
            self._add(list(zip(map(int, row.seed_at_), map(float, row.seed_l_), map(float, row.seed_r_), strict=True)))
            self.held.update((list(map(float, row.filter_)) if row.filter_ is not None else None, list(map(float, row.steady_)) if row.steady_ is not None else None, int(row.last_)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            new = [(int(a), float(l), float(r)) for a, l, r in zip(pdf["due_"], pdf["l_"], pdf["r_"], strict=True)]
            self.waiting.appendList(new)
            self.handle.registerTimer(min(a for a, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        filtered, steady, last = self.held.get() if self.held.exists() else (None, None, -(2**62))
        due = [r for k, r in enumerate(due) if r[0] > last and (k + 1 == len(due) or due[k + 1][0] > r[0])]
        if not due:
            return
        oldest = due[0][0] - self.s.lookback
        known: list[tuple[int, float, float]] = []
        for (day,), value in list(self.days.iterator()):
            if (day + 1) * DAY <= oldest:
                self.days.removeKey((day,))  # expired
            else:
                known += zip(*value, strict=True)
        normal, frames = NormalDist(), [Frame(self.s.lookback + 1) for _ in range(3)]

        def ranks(at: int, l: float, r: float) -> list[float]:
            return [midrank(f, at, x, self.s.least) for f, x in zip(frames, (l / (l + r + EPS), l - r, l + r), strict=True)]

        for row in sorted(known):
            ranks(*row)
        z = np.array([[normal.inv_cdf(min(max(p, self.s.clip), 1 - self.s.clip)) if p == p else np.nan for p in ranks(*row)] for row in due])
        self._add(due)
        seen = ~np.isnan(z).any(axis=1)
        out = np.full((len(due), 3), np.nan)
        states = [list(f) if f is not None else p.start() for f, p in zip((filtered, steady), self.parts, strict=True)]
        if seen.any():
            found, states[0] = self.parts[0].run(states[0], z[seen])
            best, sure = found[:, -2], found[:, -1]
            steady_rows, states[1] = self.parts[1].run(states[1], np.column_stack([best, sure]))
            out[seen] = np.column_stack([best, sure, steady_rows[:, 0]])
        self.held.update((list(map(float, states[0])), list(map(float, states[1])), int(due[-1][0])))
        yield pd.DataFrame({**{k: [v] * len(due) for k, v in zip(self.keys, key, strict=True)}, "at_": [r[0] for r in due], "state": out[:, 0], "confidence": out[:, 1], "steady": out[:, 2]})

    def close(self) -> None:
        pass


def engine_seed(history: DataFrame, keys: Sequence[str], ts: str, long_side: str, short_side: str, model: Gaussians, s: stages.ObservationSettings = stages.ObservationSettings(), confirm: int = 2, switch: float = 0.6) -> DataFrame:
    """What ``engine`` would hold after the rows of a batch frame: the values of the last ``lookback``, the filter and the state held, one row for each key."""
    seen = stages.observation_features(history, keys, ts, long_side, short_side, s).dropna(subset=list(stages.FEATURES))
    held = scans.last_states(seen, keys, [ts], stages.regime_parts(model, confirm, switch)).select(*keys, F.get("_state", F.lit(0)).alias("filter_"), F.get("_state", F.lit(1)).alias("steady_"))
    rows = history.select(*keys, micros(ts).alias("at_"), F.col(long_side).cast("double").alias("l_"), F.col(short_side).cast("double").alias("r_"))
    last = rows.groupBy(*keys).agg(F.max("at_").alias("last_"))
    near = rows.join(last, list(keys)).where(F.col("at_") >= F.col("last_") - s.lookback)
    lists = near.groupBy(*keys).agg(F.max("last_").alias("last_"), F.sort_array(F.collect_list(F.struct("at_", "l_", "r_"))).alias("rows_"))
    part = lambda c: F.transform("rows_", lambda x: x[c]).alias(f"seed_{c}")
    return lists.join(held, list(keys), "left").select(*keys, part("at_"), part("l_"), part("r_"), "filter_", "steady_", "last_")


def engine(
    stream: DataFrame, keys: Sequence[str], ts: str, long_side: str, short_side: str, model: Gaussians, s: stages.ObservationSettings = stages.ObservationSettings(), confirm: int = 2, switch: float = 0.6,
    late: str = "10 minutes", seed: DataFrame | None = None,
) -> DataFrame:
    """The regime of every row, as ``online.online_engine``, from a state that expires by day, in the order of time whatever the order of arrival
    within ``late``, and going on from a ``seed`` (``engine_seed`` of a history): rows at or before a key's seed are dropped."""
    if s.span:
        raise ValueError("the engine takes unsmoothed sides")
    number = lambda c: F.col(c).cast("double")
    rows = stream.select(*keys, ts, number(long_side).alias("l_"), number(short_side).alias("r_")).withWatermark(ts, late).withColumn("due_", micros(ts))
    schema = StructType([*_schema(rows, keys).fields, *StructType.fromDDL("at_ long, state double, confidence double, steady double").fields])
    start = seed.groupBy(*keys) if seed is not None else None
    out = rows.groupBy(*keys).transformWithStateInPandas(_Engine(list(keys), model, s, confirm, switch), schema, "Append", "EventTime", start)
    number_or_null: dict[str, Column] = {c: F.when(~F.isnan(c), F.col(c)).cast(kind) for c, kind in (("state", "int"), ("confidence", "double"), ("steady", "int"))}
    return out.withColumns(number_or_null).select(*keys, F.timestamp_micros("at_").alias(ts), "state", "confidence", "steady")
