"""Recurrences over ordered rows, in parallel within one series, and resumable from a table of states.

A ``Recurrence`` carries a flat vector of numbers over a key's rows. ``scan`` runs several of them in one sorted pass. With ``chunk`` a series is cut
by its first order column, and three steps make it the work of many tasks: each chunk is summarised by what it does to whatever state
enters it (the recurrences are compositions of affine, Moebius or matrix maps, composed pairwise in NumPy), the summaries of a key, one row for each
chunk, are applied one after the other, and each chunk's rows then run from the state that enters it. ``last_states`` gives the
state after a key's last row; ``scan`` with these states over later rows goes on as if it had seen all of them.

Rows whose first order column is NULL come first, as a chunk of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from chronoloom.functions.frames import Keys
from chronoloom.functions.scalar import finite, micros


class Recurrence(Protocol):
    """``inputs`` and ``outputs`` are columns (all doubles); a state is a list of numbers, NaN for what isn't known yet."""

    inputs: Sequence[str]
    outputs: Sequence[str]

    def start(self) -> list[float]:
        """The state before a key's first row."""

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """Outputs of some rows (rows x inputs -> rows x outputs) and the state after them."""

    def summary(self, x: np.ndarray) -> list[float]:
        """What some rows do to any state that enters them."""

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        """The state after the rows of a summary."""


#: One vector for each recurrence.
_VECTORS = ArrayType(ArrayType(DoubleType()))

Compose = Callable[[tuple[np.ndarray, ...], tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]


def composed(parts: tuple[np.ndarray, ...], identity: tuple[np.ndarray | float, ...], compose: Compose) -> tuple[np.ndarray, ...]:
    """One map from maps in order (arrays along the first axis), pair by pair."""
    if not len(parts[0]):
        return tuple(np.array(i, float) for i in identity)
    while (n := len(parts[0])) > 1:
        if n % 2:
            parts = tuple(np.concatenate([p, np.broadcast_to(np.array(i, float), (1, *p.shape[1:]))]) for p, i in zip(parts, identity, strict=True))
        parts = compose(tuple(p[::2] for p in parts), tuple(p[1::2] for p in parts))
    return tuple(p[0] for p in parts)


def _affine(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """y -> a y + b, one after the other."""
    (a, b), (c, d) = first, then
    return a * c, c * b + d


@dataclass(frozen=True)
class Average:
    """Exponential average without adjustment. A NULL keeps the average; unless ``ignore_na`` its weight decays meanwhile.

    State: the average, its weight. Summary: rows before the first value, that value, and the affine map of the others and rows after the last."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    alpha: float
    ignore_na: bool = True

    def start(self) -> list[float]:
        return [np.nan, 1.0]

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        y, weight, keep, alpha = state[0], state[1], 1 - self.alpha, self.alpha
        out = np.empty(len(x))
        for i, v in enumerate(x[:, 0].tolist()):
            if v == v:
                w = weight * keep
                y = (w * y + alpha * v) / (w + alpha) if y == y else v
                weight = 1.0
            elif y == y and not self.ignore_na:
                weight *= keep
            out[i] = y
        return out[:, None], [y, weight]

    def summary(self, x: np.ndarray) -> list[float]:
        at = np.flatnonzero(~np.isnan(x[:, 0]))
        if not len(at):
            return [len(x), np.nan, 1.0, 0.0, 0.0]
        n, keep = len(at) - 1, 1 - self.alpha
        if self.ignore_na or n == at[-1] - at[0]:  # equal steps: the map in one product
            b = self.alpha * (keep ** np.arange(n - 1, -1, -1.0) @ x[at[1:], 0])
            return [float(at[0]), float(x[at[0], 0]), keep**n, float(b), float(len(x) - 1 - at[-1])]
        w = keep ** np.diff(at)
        a, b = composed((w / (w + self.alpha), self.alpha / (w + self.alpha) * x[at[1:], 0]), (1.0, 0.0), _affine)
        return [float(at[0]), float(x[at[0], 0]), float(a), float(b), float(len(x) - 1 - at[-1])]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        (y, weight), (lead, first, a, b, trail) = state, summary
        decay = lambda n: 1.0 if self.ignore_na else (1 - self.alpha) ** n
        if first != first:
            return [y, weight * decay(lead) if y == y else weight]
        w = weight * decay(lead) * (1 - self.alpha)
        y = (w * y + self.alpha * first) / (w + self.alpha) if y == y else first
        return [a * y + b, decay(trail)]


@dataclass(frozen=True)
class Adaptive:
    """y + a (x - y) with a weight of each row; rows without value or weight hold, the first with both is the start.

    State: y. Summary: the first row's value and weight, and the affine map of the others."""

    inputs: Sequence[str]  # value, weight
    outputs: Sequence[str]

    def start(self) -> list[float]:
        return [np.nan]

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        y = state[0]
        out = np.empty(len(x))
        for i, (v, a) in enumerate(x.tolist()):
            if v == v and a == a:
                y = y + a * (v - y) if y == y else v
            out[i] = y
        return out[:, None], [y]

    def summary(self, x: np.ndarray) -> list[float]:
        x = x[~np.isnan(x).any(axis=1)]
        if not len(x):
            return [np.nan, 0.0, 1.0, 0.0]
        a, b = composed((1 - x[1:, 1], x[1:, 1] * x[1:, 0]), (1.0, 0.0), _affine)
        return [float(x[0, 0]), float(x[0, 1]), float(a), float(b)]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        (y,), (v, w, a, b) = state, summary
        if v != v:
            return [y]
        return [a * (y + w * (v - y) if y == y else v) + b]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of 2 x 2 matrices along the last two axes."""
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    return np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2) / (a * d - b * c)[..., None, None]


def _gaussian_level(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """``_gaussian`` for a state of one number."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    d = 1 + c1 * j2
    return a1 * a2 / d, a2 * (b1 + c1 * e2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (e2 - j2 * b1) / d + e1, a1 * a1 * j2 / d + j1


def _gaussian(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Steps of a linear Gaussian filter, one after the other: each is (transition A, offset b, covariance C, information vector e and matrix J).

    The parallel-scan form of the Kalman filter (Sarkka and Garcia-Fernandez, 2021); matrices along the last two axes."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    eye = np.eye(a1.shape[-1])
    t = lambda m: np.swapaxes(m, -1, -2)
    forward = a2 @ _inverse(eye + c1 @ j2)
    back = t(a1) @ _inverse(eye + j2 @ c1)
    return forward @ a1, forward @ (b1 + c1 @ e2) + b2, forward @ c1 @ t(a2) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1


def _steps(x: np.ndarray, move: np.ndarray, drift: np.ndarray, noise: float) -> tuple[np.ndarray, ...]:
    """Predict and update of each value (of the state's first part) as steps of ``_gaussian``; a NaN only predicts."""
    n, d = len(x), len(move)
    seen = np.eye(1, d)
    s = (seen @ drift @ seen.T).item() + noise
    gain = drift @ seen.T / s
    known, v = ~np.isnan(x), np.nan_to_num(x)[:, None, None]
    pick = lambda a, b: np.where(known[:, None, None], a, b)
    a = pick((np.eye(d) - gain @ seen) @ move, move)
    return a, pick(gain * v, 0.0), pick((np.eye(d) - gain @ seen) @ drift, drift), pick(move.T @ seen.T / s * v, 0.0), pick(move.T @ seen.T @ seen @ move / s, np.zeros((d, d))) * np.ones((n, 1, 1))


def _identity(d: int) -> tuple[np.ndarray, ...]:
    return np.eye(d), np.zeros((d, 1)), np.zeros((d, d)), np.zeros((d, 1)), np.zeros((d, d))


def _flat(parts: tuple[np.ndarray, ...]) -> list[float]:
    return [float(v) for p in parts for v in p.ravel()]


def _advance(mean: np.ndarray, covariance: np.ndarray, flat: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """State mean and covariance after the steps of a summary."""
    d = len(mean)
    a, b, c, e, j = (np.array(p).reshape(shape) for p, shape in zip(np.split(np.array(flat), np.cumsum([d * d, d, d * d, d])), [(d, d), (d, 1), (d, d), (d, 1), (d, d)], strict=True))
    k = a @ _inverse(np.eye(d) + covariance @ j)
    return k @ (mean + covariance @ e) + b, k @ covariance @ a.T + c


@dataclass(frozen=True)
class Level:
    """Random-walk Kalman filter, not below 0. The first observation updates the prior as it is; a NULL only predicts.

    State: mean, variance, whether a row came before."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    mean: float = 0.49
    variance: float = 50.0
    noise: float = 80.0
    drift: float = 0.05

    def start(self) -> list[float]:
        return [self.mean, self.variance, 0.0]

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        m, p, begun = state
        out = np.empty(len(x))
        for i, v in enumerate(x[:, 0].tolist()):
            if begun:
                p += self.drift
            begun = 1.0
            if v == v:
                gain = p / (p + self.noise)
                m, p = m + gain * (v - m), (1 - gain) * p
            out[i] = m if m > 0.0 else 0.0
        return out[:, None], [m, p, begun]

    def summary(self, x: np.ndarray) -> list[float]:
        known, v, s = ~np.isnan(x[:, 0]), np.nan_to_num(x[:, 0]), self.drift + self.noise
        gain = np.where(known, self.drift / s, 0.0)
        steps = (1 - gain, gain * v, (1 - gain) * self.drift, np.where(known, v / s, 0.0), np.where(known, 1 / s, 0.0))
        return [float(p) for p in composed(steps, (1.0, 0.0, 0.0, 0.0, 0.0), _gaussian_level)]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        (m, p, begun), (a, b, c, e, j) = state, summary
        p = p if begun else p - self.drift  # the first row adds the drift that it shouldn't
        return [a * (m + p * e) / (1 + p * j) + b, a * a * p / (1 + p * j) + c, 1.0]


@dataclass(frozen=True)
class Slope:
    """Slope of a local linear trend (level and slope) by a two-state Kalman filter; NULLs only predict; the first value starts it at slope 0
    (with ``update_first`` that row then predicts and updates as well).

    State: level, slope, their covariances. Summary: the steps of all rows, the first value, and the steps of the rows after it."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    level_noise: float = 1e-4
    slope_noise: float = 1e-5
    noise: float = 1e-2
    update_first: bool = False

    def start(self) -> list[float]:
        return [np.nan] * 5

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        level, slope, p00, p01, p11 = state
        out = np.full(len(x), np.nan)
        for i, v in enumerate(x[:, 0].tolist()):
            if level != level:
                if v == v:
                    level, slope, p00, p01, p11 = v, 0.0, 1.0, 0.0, 1.0
                    out[i] = 0.0
                if not (v == v and self.update_first):
                    continue
            level, p00, p01, p11 = level + slope, p00 + 2 * p01 + p11 + self.level_noise, p01 + p11, p11 + self.slope_noise
            if v == v:
                s, e = p00 + self.noise, v - level
                k0, k1 = p00 / s, p01 / s
                level, slope = level + k0 * e, slope + k1 * e
                p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
            out[i] = slope
        return out[:, None], [level, slope, p00, p01, p11]

    def _over(self, x: np.ndarray) -> list[float]:
        move, drift = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([self.level_noise, self.slope_noise])
        return _flat(composed(_steps(x, move, drift, self.noise), _identity(2), _gaussian))

    def summary(self, x: np.ndarray) -> list[float]:
        at = np.flatnonzero(~np.isnan(x[:, 0]))
        first = at[0] if len(at) else len(x)
        return [float(x[first, 0]) if len(at) else np.nan, *self._over(x[:, 0]), *self._over(x[first + (not self.update_first) :, 0])]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        first, half = summary[0], (len(summary) - 1) // 2
        if state[0] == state[0]:
            level, slope, p00, p01, p11 = state
            mean, cov = _advance(np.array([[level], [slope]]), np.array([[p00, p01], [p01, p11]]), summary[1 : 1 + half])
        elif first == first:
            mean, cov = _advance(np.array([[first], [0.0]]), np.eye(2), summary[1 + half :])
        else:
            return state
        return [*mean.ravel().tolist(), cov[0, 0].item(), cov[0, 1].item(), cov[1, 1].item()]


@dataclass(frozen=True)
class Filter:
    """Forward filter of a hidden Markov model: state probabilities, the best state, its probability. A row with a NaN says nothing.

    ``density`` gives the states' log densities of rows. State: the probabilities. Summary: the first row's densities and the product of
    the others' transition matrices, each weighted by its densities."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    first: np.ndarray
    move: np.ndarray
    density: Callable[[np.ndarray], np.ndarray]

    def start(self) -> list[float]:
        return [np.nan] * len(self.first)

    def _weights(self, x: np.ndarray) -> np.ndarray:
        d = self.density(x)
        return np.exp(d - d.max(axis=1, keepdims=True)) + 1e-300

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        a = None if state[0] != state[0] else np.array(state)
        b = self._weights(x)
        out = np.empty((len(x), len(self.first)))
        for i in range(len(x)):
            a = (self.first if a is None else a @ self.move) * b[i]
            a = a / a.sum()
            out[i] = a
        best = out.argmax(axis=1)
        return np.column_stack([out, best, out.max(axis=1)]), state if a is None else a.tolist()

    def summary(self, x: np.ndarray) -> list[float]:
        b = self._weights(x)

        def times(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            m = first[0] @ then[0]
            return (m / m.sum(axis=(1, 2), keepdims=True),)

        (m,) = composed((self.move[None] * b[1:, None, :],), (np.eye(len(self.first)),), times)
        return [*b[0].tolist(), *m.ravel().tolist()]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        k = len(self.first)
        a = (self.first if state[0] != state[0] else np.array(state) @ self.move) * np.array(summary[:k])
        a = (a / a.sum()) @ np.array(summary[k:]).reshape(k, k)
        return (a / a.sum()).tolist()


@dataclass(frozen=True)
class RunLength:
    """Rows for which a value (a number, NULL is one too) has stood. State: the value, whether any, the rows. Summary: the first and
    the last run, and whether they are one."""

    inputs: Sequence[str]
    outputs: Sequence[str]

    def start(self) -> list[float]:
        return [np.nan, 0.0, 0.0]

    @staticmethod
    def _same(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
        return (a == b) | (np.isnan(a) & np.isnan(b))

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        v = x[:, 0]
        change = np.append(True, ~self._same(v[1:], v[:-1]))
        begin = np.maximum.accumulate(np.where(change, np.arange(len(v)), 0))
        out = np.arange(len(v)) - begin + 1.0
        if state[1] and self._same(v[0], state[0]):
            out[begin == 0] += state[2]
        return out[:, None], [float(v[-1]), 1.0, float(out[-1])]

    def summary(self, x: np.ndarray) -> list[float]:
        out, last = self.run(self.start(), x)
        return [float(x[0, 0]), float(x[-1, 0]), last[2], float(last[2] == len(x))]

    def enter(self, state: list[float], summary: list[float]) -> list[float]:
        first, last, n, whole = summary
        more = state[2] if whole and state[1] and self._same(first, state[0]) else 0.0
        return [last, 1.0, n + more]


@dataclass(frozen=True)
class Debounce:
    """Switches to another state after ``confirm`` rows in a row say so with confidence, and not before ``least_rows`` rows. A row without a
    state is no evidence. Resumable, but what it does to a state isn't summed up: no chunks.

    State: the state held, the one that waits, its rows, the age."""

    inputs: Sequence[str]  # candidate, confidence
    outputs: Sequence[str]
    confirm: int
    switch: float
    least_rows: int = 1

    def start(self) -> list[float]:
        return [np.nan, np.nan, 0.0, 0.0]

    def run(self, state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        current, waiting, count, age = state
        out = np.empty(len(x))
        for i, (s, p) in enumerate(x.tolist()):
            if s == s and current != current:
                current, age = s, 0
            age += 1
            if s == current or s != s or not p >= self.switch:
                waiting, count = np.nan, 0
            else:
                count = count + 1 if s == waiting else 1
                waiting = s
                if count >= self.confirm and age > self.least_rows:
                    current, waiting, count, age = s, np.nan, 0, 1
            out[i] = current
        return out[:, None], [current, waiting, float(count), float(age)]

    def summary(self, x: np.ndarray) -> list[float]:
        raise NotImplementedError("the decision can't be cut into chunks")

    enter = summary


def _chunk_of(df: DataFrame, column: str, width: int) -> Column:
    at = micros(column) if dict(df.dtypes)[column].startswith(("timestamp", "date")) else F.col(column)
    return F.floor(at / width).cast("long")


def _runs(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Parts of batches with equal ``by``, and whether each begins a new one."""
    last: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[list(by)]
        change = (~((keys == keys.shift()) | (keys.isna() & keys.shift().isna()))).any(axis=1).to_numpy()
        change[0] = True
        cuts = np.append(np.flatnonzero(change), len(pdf))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(None if v is None or v != v else v for v in keys.iloc[lo])
            yield own != last, pdf.iloc[lo:hi]
            last = own


def _sorted(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _numbers(rows: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return rows[list(columns)].to_numpy(float)


def _inputs(parts: Sequence[Recurrence]) -> list[str]:
    made = [c for p in parts for c in p.outputs]
    return [c for c in dict.fromkeys(c for p in parts for c in p.inputs) if c not in made]


def _summaries(df: DataFrame, keys: Keys, order: Sequence[str], parts: Sequence[Recurrence], chunk: int | None) -> DataFrame:
    """keys, _chunk, _summary (an array for each recurrence), _last (of the first order column), without chunks one for each key."""
    made = {c for p in parts for c in p.outputs}
    if any(c in made for p in parts for c in p.inputs):
        raise ValueError("recurrences over each other's outputs have no summary: scan them one after the other")
    cut = df.select(*keys, *order, *[F.col(c).cast("double").alias(f"_in_{c}") for c in _inputs(parts)], (_chunk_of(df, order[0], chunk) if chunk else F.lit(0).cast("long")).alias("_chunk"))
    by, columns = [*keys, "_chunk"], [[f"_in_{c}" for c in p.inputs] for p in parts]
    schema = StructType([cut.schema[c] for c in by] + [cut.schema[order[0]]]).add("_summary", _VECTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            rows = pd.concat(held) if len(held) > 1 else held[0]
            out = rows.iloc[-1:][[*by, order[0]]].copy()
            out["_summary"] = [[p.summary(_numbers(rows, c)) for p, c in zip(parts, columns, strict=True)]]
            return out

        for new, rows in _runs(batches, by):
            if new and held:
                yield done()
                held.clear()
            held.append(rows)
        if held:
            yield done()

    return _sorted(cut, by, order).mapInPandas(run, schema)


def _states(summaries: DataFrame, keys: Keys, order: Sequence[str], parts: Sequence[Recurrence], states: DataFrame | None, last: bool) -> DataFrame:
    """States that enter each chunk (keys, _chunk, _state), or with ``last`` those after each key's last one (keys, first order column, _state)."""
    at = order[0]
    seeds = summaries.select(*keys, "_chunk", at, "_summary", F.lit(None).cast(_VECTORS).alias("_state"), F.lit(1).alias("_kind"))
    if states is not None:
        seeds = seeds.unionByName(states.select(*keys, F.lit(None).cast("long").alias("_chunk"), at, F.lit(None).cast(_VECTORS).alias("_summary"), "_state", F.lit(0).alias("_kind")))
    schema = StructType([summaries.schema[k] for k in [*keys, at if last else "_chunk"]]).add("_state", _VECTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[list[float]] = []
        held: pd.DataFrame | None = None

        def out(row: pd.DataFrame) -> pd.DataFrame:
            return row.iloc[-1:][[*keys, at if last else "_chunk"]].assign(_state=[[list(s) for s in state]])

        for new, rows in _runs(batches, keys):
            if new:
                if last and held is not None:
                    yield out(held)
                state = [p.start() for p in parts]
            for i in range(len(rows)):
                row = rows.iloc[i : i + 1]
                if row["_kind"].iloc[0] == 0:
                    state = [list(map(float, s)) for s in row["_state"].iloc[0]]
                else:
                    if not last:
                        yield out(row)
                    state = [p.enter(s, list(map(float, v))) for p, s, v in zip(parts, state, row["_summary"].iloc[0], strict=True)]
                held = row
        if last and held is not None:
            yield out(held)

    return _sorted(seeds, keys, ["_kind", "_chunk"]).mapInPandas(run, schema)


def scan(df: DataFrame, keys: Keys, order: Sequence[str], parts: Sequence[Recurrence], *, chunk: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """The rows with the outputs of all recurrences; one may read what an earlier one makes (not with ``chunk``).

    ``chunk``: width of a chunk in the first order column (microseconds for times). ``states``: where each key's series goes on (``last_states``)."""
    cut, names = df, df.columns
    keys = list(keys)
    if chunk:
        cut = df.withColumn("_chunk", _chunk_of(df, order[0], chunk))
        seeds = _states(_summaries(df, keys, order, parts, chunk), keys, order, parts, states, last=False)
        by = [*keys, "_chunk"]
    else:
        seeds, by = states.select(*keys, "_state") if states is not None else None, keys
    cut = cut.select("*", *[F.col(c).cast("double").alias(f"_in_{c}") for c in _inputs(parts)])
    if seeds is not None:
        # as text: a column of nested arrays that is NULL in all rows but one of each chunk costs more than the scan
        cut = cut.withColumn("_seed", F.lit(None).cast("string")).unionByName(seeds.select(*by, F.to_json("_state").alias("_seed")), allowMissingColumns=True)
    fresh, seeded = _inputs(parts), seeds is not None
    schema = StructType([df.schema[c] for c in names])
    for c in (c for p in parts for c in p.outputs):
        schema = schema.add(c, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[list[float]] = []
        for new, rows in _runs(batches, by):
            if new:
                state = [p.start() for p in parts]
                if seeded and isinstance(seed := rows["_seed"].iloc[0], str):
                    state, rows = [[np.nan if v is None else float(v) for v in s] for s in json.loads(seed)], rows.iloc[1:]
                    if not len(rows):
                        continue
            made = {c: rows[f"_in_{c}"].to_numpy(float) for c in fresh}
            for k, p in enumerate(parts):
                out, state[k] = p.run(state[k], np.column_stack([made[c] for c in p.inputs]))
                made |= {c: out[:, j] for j, c in enumerate(p.outputs)}
            yield rows[names].assign(**{c: made[c] for p in parts for c in p.outputs})

    order_by = [F.col("_seed").isNull(), *order] if seeds is not None else list(order)
    found = cut.repartition(*by).sortWithinPartitions(*by, *order_by).mapInPandas(run, schema)
    return found.withColumns({c: finite(F.col(c)) for p in parts for c in p.outputs})


def tails(df: DataFrame, keys: Keys, order: Sequence[str], parts: Sequence[Average], n: int, marks: DataFrame, mark: str, chunk: int) -> DataFrame:
    """The rows that a look back from the times ``mark`` of ``marks`` can see, at most ``n`` deep, and a few more; on the last row at or before each such
    time the averages of all rows so far, as ``scan`` gives them (elsewhere NULL or the same).

    Rows between two times of a key are a slot: each is summed up where it lies, in a chunk of ``chunk`` microseconds, and only sums and
    last rows meet by key. So a key of many rows is the work of many tasks, and no row is stepped through.
    """
    keys, names, at = list(keys), df.columns, micros(order[0])
    times = marks.select(*keys, micros(mark).alias("_at"), micros(mark).alias("_mark"))
    both = df.withColumns({"_at": at, "_own": F.lit(True)}).unionByName(times, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("_at") / chunk))
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_at"), F.asc_nulls_last("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    slotted = both.repartition(*keys, "_chunk").withColumn("_slot", F.last("_mark", True).over(ahead)).where("_own")
    inputs = _inputs(parts)
    by = [*keys, "_chunk", "_slot"]
    cut = slotted.select(*names, "_chunk", "_slot", *[F.col(c).cast("double").alias(f"_in_{c}") for c in inputs])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # a slot may come in several batches: each is a slot of its own
            if not len(pdf):
                continue
            slot = pdf[by]
            new = (~((slot == slot.shift()) | (slot.isna() & slot.shift().isna()))).any(axis=1).to_numpy()
            new[0] = True
            cuts = np.append(np.flatnonzero(new), len(pdf))
            x = {c: pdf[f"_in_{c}"].to_numpy(float)[:, None] for c in inputs}
            kept = np.concatenate([np.arange(max(lo, hi - n), hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
            summary = np.full(len(pdf), None, object)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if parts else ():
                summary[hi - 1] = [p.summary(x[p.inputs[0]][lo:hi]) for p in parts]
            yield pdf.iloc[kept][names].assign(_summary=summary[kept])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[list[float]] = []
        for new, rows in _runs(batches, keys):
            if new:
                state = [p.start() for p in parts]
            made = np.full((len(rows), len(parts)), np.nan)
            for i, summary in enumerate(rows["_summary"]):
                if summary is not None:
                    state = [p.enter(s, list(map(float, v))) for p, s, v in zip(parts, state, summary, strict=True)]
                    made[i] = [s[0] for s in state]
            yield rows[names].assign(**{p.outputs[0]: made[:, k] for k, p in enumerate(parts)})

    # partitioned by keys and chunk since the window; slots without a time after them in their chunk come last
    ends = cut.sortWithinPartitions(*keys, "_chunk", F.asc_nulls_last("_slot"), *order).mapInPandas(sums, StructType([df.schema[c] for c in names]).add("_summary", _VECTORS))
    if not parts:
        return ends.drop("_summary")
    schema = StructType([df.schema[c] for c in names])
    for p in parts:
        schema = schema.add(p.outputs[0], "double")
    return _sorted(ends, keys, order).mapInPandas(enter, schema).withColumns({p.outputs[0]: finite(F.col(p.outputs[0])) for p in parts})


def last_states(df: DataFrame, keys: Keys, order: Sequence[str], parts: Sequence[Recurrence], *, chunk: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """keys, the first order column's last value and ``_state`` after each key's last row: where ``scan`` goes on. Keys of ``states`` without new rows keep theirs.

    Recurrences that can be summed up are (by chunk if wanted); the others run row by row."""
    made = {c for p in parts for c in p.outputs}
    if chunk or not (any(isinstance(p, Debounce) for p in parts) or any(c in made for p in parts for c in p.inputs)):
        return _states(_summaries(df, keys, order, parts, chunk), keys, order, parts, states, last=True)
    fresh, at = _inputs(parts), order[0]
    cut = df.select(*keys, *order, *[F.col(c).cast("double").alias(f"_in_{c}") for c in fresh], F.lit(None).cast(_VECTORS).alias("_state"))
    if states is not None:
        cut = cut.unionByName(states.select(*keys, at, "_state"), allowMissingColumns=True)
    schema = StructType([cut.schema[c] for c in [*keys, at]]).add("_state", _VECTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[list[float]] = []
        held: pd.DataFrame | None = None

        def out() -> pd.DataFrame:
            return held[[*keys, at]].assign(_state=[[list(map(float, s)) for s in state]])

        for new, rows in _runs(batches, keys):
            if new:
                if held is not None:
                    yield out()
                state, held = [p.start() for p in parts], rows.iloc[-1:]
                if rows["_state"].iloc[0] is not None:
                    state, rows = [list(map(float, s)) for s in rows["_state"].iloc[0]], rows.iloc[1:]
            if len(rows):
                made = {c: rows[f"_in_{c}"].to_numpy(float) for c in fresh}
                for k, p in enumerate(parts):
                    res, state[k] = p.run(state[k], np.column_stack([made[c] for c in p.inputs]))
                    made |= {c: res[:, j] for j, c in enumerate(p.outputs)}
                held = rows.iloc[-1:]
        if held is not None:
            yield out()

    return cut.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("_state"), *order).mapInPandas(run, schema)


def later(df: DataFrame, states: DataFrame, keys: Keys, at: str) -> DataFrame:
    """The rows after their key's last one in ``states``, and those of new keys."""
    known = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).alias("_mark"))
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(known, same, "left").where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).select(*df.columns)
