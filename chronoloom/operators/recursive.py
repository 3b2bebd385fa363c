"""Recursive operators: state is carried over the ordered rows of each key.

Averages and filters are recurrences of ``scans``. ``ordered_scan``, for others, sorts by key and time within partitions and streams Arrow
batches; only the state of the key in hand is kept, so a series may be of any length. Finite filters are plain windows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.functions.frames import Keys, ordered
from chronoloom.functions.scalar import divide, log_guarded
from chronoloom.operators import scans

#: (state or None at the start of a key, rows of one key in order) -> (new columns, state)
Step = Callable[[object, pd.DataFrame], tuple[dict[str, np.ndarray], object]]


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, outputs: str) -> DataFrame:
    """Adds the columns of ``outputs`` (DDL), computed by ``step`` over the rows of each key in order."""
    added = StructType.fromDDL(outputs)
    schema = StructType(df.schema.fields + added.fields)
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state: object = None
        for pdf in batches:
            if not len(pdf):
                continue
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            change[0] = True
            cuts = np.append(np.flatnonzero(change), len(pdf))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[lo:hi]
                own = tuple(part[k].iloc[0] for k in keys)
                if own != key:
                    key, state = own, None
                columns, state = step(state, part)
                yield part.assign(**columns)[schema.names]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ema(df: DataFrame, keys: Keys, order: Sequence[str], value: str, span: float, out: str, ignore_na: bool = True, chunk: int | None = None) -> DataFrame:
    """Exponential average (``scans.Average``); with ``chunk`` one series is the work of many tasks."""
    return scans.scan(df, keys, order, [scans.Average([value], [out], 2 / (span + 1), ignore_na)], chunk=chunk)


def kalman_level(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str, out: str, mean: float = 0.49, variance: float = 50.0, noise: float = 80.0, drift: float = 0.05, chunk: int | None = None
) -> DataFrame:
    """Level by a random-walk Kalman filter (``scans.Level``)."""
    return scans.scan(df, keys, order, [scans.Level([value], [out], mean, variance, noise, drift)], chunk=chunk)


def local_slope(df: DataFrame, keys: Keys, order: Sequence[str], value: str, out: str, level_noise: float = 1e-4, slope_noise: float = 1e-5, noise: float = 1e-2, chunk: int | None = None, update_first: bool = False) -> DataFrame:
    """Slope of a local linear trend (``scans.Slope``)."""
    return scans.scan(df, keys, order, [scans.Slope([value], [out], level_noise, slope_noise, noise, update_first)], chunk=chunk)


def kama(df: DataFrame, keys: Keys, ts: str, value: str, n: int, out: str, fast: int = 2, slow: int = 30, chunk: int | None = None, from_first: bool = False) -> DataFrame:
    """Adaptive average: the weight ((fast - slow) efficiency + slow)^2 follows |net change| / path over n rows.

    It starts at the first value with an efficiency (``from_first``: at the key's first row) and is held where that can't be formed.
    """
    w = ordered(keys, ts)
    x = F.col(value)
    df = df.withColumn("_d", F.abs(x - F.lag(x).over(w)))
    frame = w.rowsBetween(1 - n, 0)
    path = F.when(F.count("_d").over(frame) >= n, F.sum("_d").over(frame))
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    er = F.coalesce(divide(F.abs(x - F.lag(x, n).over(w)), path), F.when(path == 0, 0.0))
    df = df.withColumn("_alpha", F.pow(er * (f - s) + s, 2))
    if from_first:
        df = df.withColumn("_alpha", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("_alpha")))
    return scans.scan(df, keys, [ts], [scans.Adaptive([value, "_alpha"], [out])], chunk=chunk).drop("_d", "_alpha")


def spike(df: DataFrame, keys: Keys, ts: str, value: str, average: str, out: str, eps: float = 1e-9) -> DataFrame:
    """ln of a value against its adaptive average of the row before."""
    return df.withColumn(out, log_guarded(divide(F.col(value) + eps, F.lag(average).over(ordered(keys, ts)) + eps)))


def gaussian_fir(x: Column, keys: Keys, ts: str, n: int) -> Column:
    """Causal Gaussian average over n rows (sigma = max(n / 3, 1)), normalised over the taps that have a value."""
    w, sigma = ordered(keys, ts), max(n / 3, 1.0)
    taps = [exp(-0.5 * (k / sigma) ** 2) for k in range(n)]
    lags = [F.lag(x, k).over(w) if k else x for k in range(n)]
    top = sum((F.coalesce(t * v, F.lit(0.0)) for t, v in zip(taps, lags, strict=True)), F.lit(0.0))
    mass = sum((F.when(v.isNotNull(), t).otherwise(0.0) for t, v in zip(taps, lags, strict=True)), F.lit(0.0))
    return divide(top, mass)


# Low-pass decomposition filter of the Coiflet with three vanishing moments (fixed values).
COIF3_LOW = (
    -3.459977283621256e-05, -7.098330313814125e-05, 0.0004662169601128863, 0.0011175187708906016, -0.0025745176887502236, -0.00900797613666158,
    0.015880544863615904, 0.03455502757306163, -0.08230192710688598, -0.07179982161931202, 0.42848347637761874, 0.7937772226256206,
    0.4051769024096169, -0.06112339000267287, -0.0657719112818555, 0.023452696141836267, 0.007782596427325418, -0.003793512864491014,
)


def wavelet_end(x: np.ndarray, level: int) -> float:
    """Last value of the approximation of a level: analysis and synthesis with symmetric extension at both ends."""
    low = np.array(COIF3_LOW)
    sizes, a = [], x
    for _ in range(level):
        sizes.append(len(a))
        padded = np.pad(a, len(low) - 1, mode="symmetric") if len(a) >= len(low) - 1 else np.pad(a, len(low) - 1, mode="edge")
        a = np.convolve(padded, low, mode="valid")[1::2]
    for n in reversed(sizes):
        up = np.zeros(2 * len(a))
        up[::2] = a
        a = np.convolve(up, low[::-1])[len(low) - 2 : len(low) - 2 + n]
    return float(a[-1])


def wavelet_reach(level: int) -> int:
    """Values at the end of a history that its last approximation depends on, in whole steps of the level."""
    step = 1 << level
    return -(-(2 * len(COIF3_LOW) * step) // step) * step


@lru_cache(maxsize=4096)
def wavelet_weights(n: int, level: int) -> np.ndarray:
    """``wavelet_end`` of n values is their product with these weights: its steps transposed, from the last value back."""
    low, sizes, places = np.array(COIF3_LOW), [n], []
    f = len(low)
    for _ in range(level):
        m = sizes[-1]
        padded = np.pad(np.arange(m), f - 1, mode="symmetric" if m >= f - 1 else "edge")
        ends = np.arange(1, len(padded) - f + 1, 2)
        places.append(padded[ends[:, None] + f - 1 - np.arange(f)])
        sizes.append(len(ends))
    g = np.zeros(n)
    g[-1] = 1.0
    for m, below in zip(sizes[:-1], sizes[1:], strict=True):
        wide = np.zeros(2 * below + f - 1)
        wide[f - 2 : f - 2 + m] = g
        g = np.correlate(wide, low[::-1], "valid")[::2]
    for m, place in zip(sizes[-2::-1], reversed(places), strict=True):
        g = np.bincount(place.ravel(), (g[:, None] * low).ravel(), m)
    return g


@dataclass(frozen=True)
class Trend:
    """Wavelet trend of the strictly past ``history`` values (a recurrence of ``scans``; no chunks). State: values seen, the average that stands in, the values."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    history: int
    level: int
    fallback_span: int = 64

    def start(self) -> list[float]:
        return [np.nan]

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        history, level, least = self.history, self.level, 2 * len(COIF3_LOW)
        reach, step = wavelet_reach(level), 1 << level
        tail = min(history, reach + history % step)  # as many as reach, of the same parity at every level
        average, past, v = state[0], np.array(state[1:]), x[:, 0]
        known = np.concatenate([past, v[~np.isnan(v)]])  # the values before the row at place i are known[: before[i]]
        before = len(past) + np.cumsum(~np.isnan(v)) - ~np.isnan(v)
        ends: dict[int, float] = {}
        full = np.unique(before[before >= history])
        if len(full):
            run = np.convolve(known[full[0] - tail : full[-1]], wavelet_weights(tail, level)[::-1], "valid")
            ends = dict(zip(full.tolist(), run[full - full[0]].tolist(), strict=True))
        out = np.full(len(v), np.nan)
        for i, (n, value) in enumerate(zip(before.tolist(), v.tolist(), strict=True)):
            if n >= least:
                if n not in ends:
                    seen = known[max(0, n - reach - n % step) : n]
                    ends[n] = float(wavelet_weights(len(seen), level) @ seen)
                out[i] = max(ends[n], 0.0)
            elif average == average:
                out[i] = max(average, 0.0)
            if value == value:
                average = value if average != average else average + 2 / (self.fallback_span + 1) * (value - average)
        return out[:, None], [average, *known[-history:].tolist()]

    def summary(self, x: np.ndarray) -> list[float]:
        raise NotImplementedError("its last values are the state: no chunks")

    enter = summary


def trailing_wavelet(df: DataFrame, keys: Keys, order: Sequence[str], value: str, history: int, level: int, out: str, fallback_span: int = 64) -> DataFrame:
    """Wavelet trend of the strictly past ``history`` values: the last value of the level's approximation, not below 0.

    With less than two filter lengths of history, an exponential average stands in. The last value depends on the newest
    ``wavelet_reach`` values alone, and linearly: it is their product with fixed weights.
    """
    return scans.scan(df, keys, order, [Trend([value], [out], history, level, fallback_span)])


def cooldown_events(df: DataFrame, keys: Keys, order: Sequence[str], value: str, threshold: str, gap: int, out: str = "selected") -> DataFrame:
    """Greedy choice of rows at or above a threshold column, each more than ``gap`` rows after the one chosen before."""

    def step(state: object, rows: pd.DataFrame) -> tuple[dict[str, np.ndarray], object]:
        since = gap + 1 if state is None else state
        res = np.zeros(len(rows), bool)
        for i, hit in enumerate((rows[value] >= rows[threshold]).to_numpy()):
            res[i] = hit and since > gap
            since = 1 if res[i] else since + 1
        return {out: res}, since

    return ordered_scan(df, keys, order, step, f"{out} boolean")
