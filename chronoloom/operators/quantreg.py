"""Linear quantile regression with non-negative slopes: smoothed pinball loss, Newton steps, many fits at once.

The rows stay on the executors as blocks of numbers. A round is one job for all fits: each block adds, for every fit whose rows it has, the loss and
its derivatives at the fit's candidate steps; a few numbers a fit come back, and each fit has its own step and its own end.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalar import micros

#: Largest slope of the loss (in deviations of features and target) that counts as none.
TOLERANCE = 1e-7
#: Rows of a block; smoothing of the first rounds, before the loss's own.
BLOCK, SMOOTHER = 4_096, (1.0, 0.1, 0.01)


def bounded_minimum(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least ``z h z / 2 + c z`` with all but the first of z at 0 or more, by the active sets of Lawson and Hanson."""
    free, z = [0], np.zeros(len(c))
    z[0] = -c[0] / h[0, 0]
    for _ in range(10 * len(c)):
        w = -(h @ z + c)
        w[free] = -np.inf
        j = int(w.argmax())
        if not w[j] > 1e-12 * (1 + np.abs(c).max()):
            break
        free.append(j)
        while True:
            to = np.zeros(len(c))
            to[free] = np.linalg.lstsq(h[np.ix_(free, free)], -c[free], rcond=None)[0]
            low = [i for i in free[1:] if to[i] <= 0]
            if not low:
                z = to
                break
            share = min(z[i] / (z[i] - to[i]) if z[i] > to[i] else 0.0 for i in low)
            z = z + share * (to - z)
            free = [0, *[i for i in free[1:] if not (i in low and z[i] <= 1e-14)]]
            z[[i for i in range(1, len(c)) if i not in free]] = 0.0
    return z


@dataclass(frozen=True)
class Problem:
    """One fit: its target and quantile, and the times [start, end) of its rows in microseconds (None: no bound)."""

    target: str
    q: float = 0.65
    start: int | None = None
    end: int | None = None


class _Blocks:
    """Rows of numbers (time, targets, features) as blocks; sums over the rows of many problems at once."""

    def __init__(self, df: DataFrame, ts: str | None, targets: Sequence[str], features: Sequence[str]) -> None:
        self.targets, self.features = list(targets), list(features)
        width = 1 + len(self.targets) + len(self.features)
        time = micros(ts).cast("double") if ts else F.lit(0.0)
        columns = [time.alias("_t"), *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate([*self.targets, *self.features])]]

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = np.empty((0, width))
            for pdf in batches:
                kept = np.concatenate([kept, pdf.to_numpy(float)])
                while len(kept) >= BLOCK:
                    yield pd.DataFrame({"x": [kept[:BLOCK].ravel()]})
                    kept = kept[BLOCK:]
            if len(kept):
                yield pd.DataFrame({"x": [kept.ravel()]})

        self.width, self.blocks = width, df.select(*columns).mapInPandas(pack, "x array<double>").persist()

    def sums(self, problems: Sequence[Problem], of: Callable[[int, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all blocks of ``of`` (number of a problem, its rows' features and target); rows with a missing number are left out."""
        width, first, place = self.width, 1 + len(self.targets), {t: 1 + k for k, t in enumerate(self.targets)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(problems), size))
            for pdf in batches:
                for flat in pdf["x"]:
                    rows = np.asarray(flat, float).reshape(-1, width)
                    full, lo, hi = ~np.isnan(rows[:, first:]).any(axis=1), np.nanmin(rows[:, 0]), np.nanmax(rows[:, 0])
                    for k, p in enumerate(problems):
                        if (p.end is not None and lo >= p.end) or (p.start is not None and hi < p.start):
                            continue
                        y = rows[:, place[p.target]]
                        own = full & ~np.isnan(y)
                        if p.start is not None:
                            own &= rows[:, 0] >= p.start
                        if p.end is not None:
                            own &= rows[:, 0] < p.end
                        if own.any():
                            total[k] += of(k, rows[own, first:], y[own])
            used = np.flatnonzero(total.any(axis=1))
            if len(used):
                yield pd.DataFrame({"p": used, **{f"s{j}": total[used, j] for j in range(size)}})

        schema = "p long, " + ", ".join(f"s{j} double" for j in range(size))
        out = np.zeros((len(problems), size))
        for row in self.blocks.mapInPandas(run, schema).groupBy("p").agg(*[F.sum(f"s{j}") for j in range(size)]).collect():
            out[row[0]] = row[1:]
        return out


@dataclass
class _State:
    """Where one fit stands: scales, coefficients, the loss and its derivatives there, candidates for the next step."""

    y_scale: float
    x_scale: np.ndarray
    z: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    done: bool = False
    tried: Sequence[np.ndarray] = ()


def fit_many(
    df: DataFrame, features: Sequence[str], problems: Sequence[Problem], ts: str | None = None, ridge: float = 1e-4, smooth: float = 1e-3, rounds: int = 100, blocks: _Blocks | None = None
) -> list[tuple[float, dict[str, float], int]]:
    """(intercept, slopes, rows) of each problem's quantile; slopes are kept at 0 or more.

    Features and targets are scaled by their deviations first. The first rounds go to the minimum of the parabola of a smoother loss; then each
    round tries the whole, a half and a quarter of the step to that of the loss itself and the minimum of a parabola above the loss, which
    never fails, and takes the best. A fit ends where the slope of its loss is below ``TOLERANCE``; those that ``rounds`` don't bring there are
    warned of. Every round is one job, two more find the scales.
    """
    names, d = list(features), len(features) + 1
    own = blocks or _Blocks(df, ts, list(dict.fromkeys(p.target for p in problems)), names)
    try:
        first = own.sums(problems, lambda k, x, y: np.concatenate([[len(y)], x.sum(axis=0), [y.sum()]]), d + 1)
        n = first[:, 0]
        mean = first[:, 1:] / np.maximum(n, 1)[:, None]
        spread = np.sqrt(own.sums(problems, lambda k, x, y: np.concatenate([((x - mean[k, :-1]) ** 2).sum(axis=0), [((y - mean[k, -1]) ** 2).sum()]]), d) / np.maximum(n, 1)[:, None])
        spread[spread <= 1e-12 * np.abs(mean)] = 1.0
        at = [_State(float(s[-1]) or 1.0, np.where(s[:-1] > 0, s[:-1], 1.0), np.append(m[-1] / (s[-1] or 1.0), np.zeros(d - 1)), done=not c) for c, m, s in zip(n, mean, spread, strict=True)]
        penalty = np.diag([0.0] + [2 * ridge] * len(names))
        upper = np.triu_indices(d)

        def look(which: list[tuple[int, np.ndarray]], smooth: float) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
            """Loss, gradient, second derivatives and those of a parabola above, at candidates of some problems."""
            scales = [(at[k].y_scale, at[k].x_scale, problems[k].q) for k, _ in which]

            def of(i: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
                y_scale, x_scale, q = scales[i]
                full = np.column_stack([np.ones(len(y)), x / x_scale])
                e = y / y_scale - full @ which[i][1]
                root = np.sqrt(e * e + smooth)
                bent = [(full * b[:, None]).T @ full for b in (0.5 * smooth / root**3, 0.5 / root)]
                return np.concatenate([[((q - 0.5) * e + 0.5 * root).sum()], (q - 0.5 + 0.5 * e / root) @ full, *[b[upper] for b in bent]])

            found = []
            for (k, z), got in zip(which, own.sums([problems[k] for k, _ in which], of, 1 + d + 2 * len(upper[0])), strict=True):
                got = got / n[k]
                bent = []
                for part in np.split(got[1 + d :], 2):
                    b = np.zeros((d, d))
                    b[upper] = part
                    bent.append(b + np.triu(b, 1).T + penalty)
                found.append((got[0] + 0.5 * float(z @ penalty @ z), penalty @ z - got[1 : 1 + d], *bent))
            return found

        for level in SMOOTHER:
            which = [(k, a.z) for k, a in enumerate(at) if not a.done]
            for (k, z), (_, g, newton, _) in zip(which, look(which, level) if which else [], strict=True):
                at[k].z = bounded_minimum(newton, g - newton @ z)
        for a in at:
            a.tried = (a.z,)
        for _ in range(rounds):
            which = [(k, z) for k, a in enumerate(at) if not a.done for z in a.tried]
            if not which:
                break
            best: dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
            for (k, z), (loss, g, newton, above) in zip(which, look(which, smooth), strict=True):
                if k not in best or loss < best[k][0]:
                    best[k] = (loss, z, g, newton, above)
            for k, (loss, z, g, newton, above) in best.items():
                a = at[k]
                stuck = not loss < a.loss and a.gradient is not None  # no candidate is lower: only rounding is left
                if not stuck:
                    a.z, a.loss, a.gradient = z, loss, g
                left = np.where((np.arange(d) > 0) & (a.z <= 0), np.minimum(a.gradient, 0.0), a.gradient)
                a.done = stuck or np.abs(left).max() <= TOLERANCE
                to = bounded_minimum(newton, g - newton @ z)
                a.tried = (to, z + 0.5 * (to - z), z + 0.25 * (to - z), bounded_minimum(above, g - above @ z))
        if late := [p for p, a in zip(problems, at, strict=True) if not a.done]:
            warnings.warn(f"{len(late)} of {len(problems)} quantile regressions did not converge in {rounds} rounds", stacklevel=2)
    finally:
        if blocks is None:
            own.blocks.unpersist()
    return [(float(a.z[0] * a.y_scale), {f: float(v) for f, v in zip(names, a.z[1:] * a.y_scale / a.x_scale, strict=True)}, int(c)) if c else (0.0, dict.fromkeys(names, 0.0), 0) for a, c in zip(at, n, strict=True)]


def fit(df: DataFrame, features: Sequence[str], target: str, q: float = 0.65, ridge: float = 1e-4, smooth: float = 1e-3, rounds: int = 100) -> tuple[float, dict[str, float]]:
    """(intercept, slopes) of the q-quantile of ``target`` (see ``fit_many``)."""
    return fit_many(df, features, [Problem(target, q)], None, ridge, smooth, rounds)[0][:2]


def walk_forward(
    df: DataFrame, ts: str, folds: Sequence[tuple[str, str, str]], features: Sequence[str], targets: str | Sequence[str], q: float = 0.65, rounds: int = 100, least_train: int = 1, least_test: int = 1
) -> list[dict]:
    """Refit on [start, cut) and measures on [cut, end) for each fold and target: all fits in common rounds, all measures in one job.

    Folds with fewer rows than ``least_train`` or ``least_test`` are marked as skipped and have no measures."""
    names = [targets] if isinstance(targets, str) else list(targets)
    number = lambda t: int(pd.Timestamp(t).value // 1000)
    plan = [(k, t, *map(number, fold)) for k, fold in enumerate(folds) for t in names]
    train, test = [Problem(t, q, a, b) for _, t, a, b, _ in plan], [Problem(t, q, b, c) for _, t, _, b, c in plan]
    blocks = _Blocks(df, ts, names, features)
    try:
        fits = fit_many(df, features, train, ts, rounds=rounds, blocks=blocks)
        lines = [(a, np.array([b[f] for f in features])) for a, b, _ in fits]

        def measures(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            said = np.maximum(lines[k][0] + x @ lines[k][1], 0.0)
            off = y - said
            return np.array([len(y), said.sum(), y.sum(), (y > 0).sum(), (y <= said).sum(), np.maximum(q * off, (q - 1) * off).sum()])

        found = blocks.sums(test, measures, 6)
    finally:
        blocks.blocks.unpersist()
    out = []
    for (k, t, *_), (a, b, n), got in zip(plan, fits, found, strict=True):
        skipped = bool(n < least_train or got[0] < least_test)
        rate = dict(zip(("mean_predicted", "mean_actual", "positive_rate", "coverage", "pinball"), [None] * 5 if skipped else (got[1:] / max(got[0], 1)).tolist(), strict=True))
        out.append({"fold": k, "target": t, "start": folds[k][0], "cut": folds[k][1], "intercept": a, **b, "n_train": n, "n_test": int(got[0]), "skipped": skipped, **rate})
    return out

