"""Regime models: hidden Markov filtering, prefix decoding, debouncing, training by expectation maximisation, relabelling."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import EPS, finite
from chronoloom.operators import scans
from chronoloom.operators.recursive import ordered_scan


# Coefficients of Wichura's rational approximations of the normal quantile (algorithm AS 241), fixed values: numerator and
# denominator near the middle, in the tails, and far out in the tails, in ascending powers.
MIDDLE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, both: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + c, reversed(cs[:-1]), F.lit(cs[-1])) for cs in both)
    return top / bottom


def _inside(p: Column, eps: float) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))


def _quantile(q: Column, middle: Column, tail: Column, far: Column | None) -> Column:
    """From p - 1/2 and the arguments of the approximations; ``far`` is left out where p can't be that small."""
    tails = _ratio(tail, TAIL)
    if far is not None:
        tails = F.when(tail <= 5 - 1.6, tails).otherwise(_ratio(far, FAR))
    return F.when(F.abs(q) <= 0.425, q * _ratio(middle, MIDDLE)).otherwise(F.signum(q) * tails)


def probit(p: Column, eps: float = 1e-4) -> Column:
    """Standard normal quantile of a probability kept away from 0 and 1."""
    p = _inside(p, eps)
    q, r = p - 0.5, F.sqrt(-F.ln(F.least(p, 1 - p)))
    return _quantile(q, 0.180625 - q * q, r - 1.6, r - 5.0 if eps < np.exp(-25) else None)


def with_probits(df: DataFrame, probabilities: Mapping[str, str], eps: float = 1e-4) -> DataFrame:
    """``probit`` of several columns (output: probability), in steps, so that the generated code stays small."""
    names, far = list(enumerate(probabilities.items())), eps < np.exp(-25)
    c = lambda x, k: F.col(f"_{x}{k}")
    df = df.withColumns({f"_p{k}": _inside(F.col(p), eps) for k, (_, p) in names})
    df = df.withColumns({f"_q{k}": c("p", k) - 0.5 for k, _ in names} | {f"_r{k}": F.sqrt(-F.ln(F.least(c("p", k), 1 - c("p", k)))) for k, _ in names})
    df = df.withColumns({f"_m{k}": 0.180625 - c("q", k) * c("q", k) for k, _ in names} | {f"_t{k}": c("r", k) - 1.6 for k, _ in names} | {f"_f{k}": c("r", k) - 5.0 for k, _ in names})
    return df.withColumns({out: _quantile(c("q", k), c("m", k), c("t", k), c("f", k) if far else None) for k, (out, _) in names}).drop(*[f"_{x}{k}" for k, _ in names for x in "pqrmtf"])


@dataclass(frozen=True)
class Gaussians:
    """A hidden Markov model with diagonal Gaussian emissions."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        return -0.5 * (np.log(2 * np.pi * self.variances).sum(1)[None] + (d * d / self.variances[None]).sum(2))

    def known_density(self, x: np.ndarray) -> np.ndarray:
        """Log densities, 0 for rows with a missing feature, which say nothing."""
        return np.where(np.isnan(x).any(axis=1)[:, None], 0.0, self.log_density(np.nan_to_num(x)))

    def reordered(self, order: Sequence[int]) -> Gaussians:
        o = np.array(order)
        return Gaussians(self.start[o], self.move[np.ix_(o, o)], self.means[o], self.variances[o])


def filter_of(features: Sequence[str], model: Gaussians, prefix: str = "p") -> scans.Filter:
    """The model's forward filter as a recurrence."""
    return scans.Filter(list(features), [*(f"{prefix}{j}" for j in range(len(model.start))), "state", "confidence"], model.start, model.move, model.known_density)


def forward_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], model: Gaussians, prefix: str = "p", chunk: int | None = None) -> DataFrame:
    """Filtered state probabilities p0..pk, the best state and its probability; rows with a NULL feature only predict."""
    return scans.scan(df, keys, order, [filter_of(features, model, prefix)], chunk=chunk).withColumn("state", F.col("state").cast("int"))


def prefix_viterbi(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], model: Gaussians, out: str = "viterbi") -> DataFrame:
    """Last state of the best path up to each row: it never looks ahead. A row with a NULL feature is a transition alone."""
    log_start, log_move = np.log(model.start + 1e-300), np.log(model.move + 1e-300)

    def step(state: object, rows: pd.DataFrame) -> tuple[dict[str, np.ndarray], object]:
        density = model.known_density(rows[list(features)].to_numpy(float))
        res, d = np.empty(len(rows), np.int32), state
        for i in range(len(rows)):
            d = (log_start if d is None else (d[:, None] + log_move).max(axis=0)) + density[i]
            d = d - d.max()
            res[i] = d.argmax()
        return {out: res}, d

    return ordered_scan(df, keys, order, step, f"{out} int")


def debounced(df: DataFrame, keys: Sequence[str], order: Sequence[str], candidate: str, confidence: str, confirm: int, switch: float, least_rows: int = 1, out: str = "steady", posteriors: Sequence[str] = ()) -> DataFrame:
    """Switches to another state after ``confirm`` rows in a row say so with confidence, and not before ``least_rows`` rows; a NULL state is no
    evidence, and until a first state comes none is held.

    With the names of the states' ``posteriors``, ``{out}_confidence`` is that of the state held."""
    held = scans.scan(df, keys, order, [scans.Debounce([candidate, confidence], [out], confirm, switch, least_rows)]).withColumn(out, F.col(out).cast("int"))
    return held.withColumn(f"{out}_confidence", F.get(F.array(*posteriors), F.col(out))) if posteriors else held


#: Rows of a block, the unit that the driver chains, and of a strip, the unit that a block steps through side by side.
BLOCK, STRIP = 4096, 64


@dataclass(frozen=True)
class _Restarts:
    """Models of all restarts, stacked along the first axis."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def density(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Densities of rows x restarts x states, each row's divided by its largest, and the logarithm of that."""
        d = x[:, None, None, :] - self.means[None]
        b = -0.5 * (np.log(2 * np.pi * self.variances).sum(2)[None] + (d * d / self.variances[None]).sum(3))
        top = b.max(2)
        return np.exp(b - top[:, :, None]), top

    def moves(self, strips: int, first: bool) -> np.ndarray:
        """What comes before a row's density, for each strip: the transition, or the start probabilities for the first row of all."""
        m = np.broadcast_to(self.move[None], (strips, *self.move.shape))
        return np.concatenate([np.broadcast_to(self.start[None, :, None, :], (1, *self.move.shape)), m[1:]]) if first else m

    def some(self, which: np.ndarray) -> _Restarts:
        return _Restarts(self.start[which], self.move[which], self.means[which], self.variances[which])

    def one(self, r: int) -> Gaussians:
        return Gaussians(self.start[r], self.move[r], self.means[r], self.variances[r])


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    z = x.sum(axis=axes, keepdims=True) + 1e-300
    return x / z, np.log(z).squeeze(axes)


def _strips(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities as strips x STRIP x restarts x states, filled up at the end, and which rows are real."""
    n, pad = len(b), -len(b) % STRIP
    real = np.arange(n + pad) < n
    return np.concatenate([b, np.ones((pad, *b.shape[1:]))]).reshape(-1, STRIP, *b.shape[1:]), real.reshape(-1, STRIP)


def _passes(models: _Restarts, b: np.ndarray, is_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The matrix by which each strip changes the state probabilities (transition, then density, row by row) and its scale."""
    rows, real = _strips(b)
    k = b.shape[2]
    m = np.broadcast_to(np.eye(k) / k, (len(rows), b.shape[1], k, k)).copy()
    scale = np.full(m.shape[:2], np.log(k))
    for t in range(STRIP):
        step, z = _scaled(m @ models.moves(len(rows), is_first and t == 0) * rows[:, t, :, None, :], (2, 3))
        on = real[:, t]
        m[on] = step[on]
        scale[on] += z[on]
    return m, scale


def _chain(m: np.ndarray, scale: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities before each unit, weights of the rows after each unit, and the log likelihood of all units."""
    n = len(m)
    before, after, total = np.empty((n, *first.shape)), np.empty((n, *last.shape)), np.zeros(len(first))
    a = first
    for u in range(n):
        before[u] = a
        a, z = _scaled((a[:, None, :] @ m[u])[:, 0], (1,))
        total += z + scale[u]
    w = last
    for u in range(n - 1, -1, -1):
        after[u] = w
        w, _ = _scaled((m[u] @ w[:, :, None])[:, :, 0], (1,))
    return before, after, total


def _expected(models: _Restarts, x: np.ndarray, before: np.ndarray, after: np.ndarray, is_first: bool) -> np.ndarray:
    """Expected counts of a block (restarts x numbers): moves, rows, sums and squares by state, states of the first row, log likelihood."""
    b, top = models.density(x)
    rows, real = _strips(b)
    strips, r, k = len(rows), b.shape[1], b.shape[2]
    a, w, likelihood = _chain(*_passes(models, b, is_first), before, after)
    alpha = np.empty((strips, STRIP, r, k))
    for t in range(STRIP):
        alpha[:, t] = a
        a, _ = _scaled((a[:, :, None, :] @ models.moves(strips, is_first and t == 0))[:, :, 0] * rows[:, t], (2,))
    moves, states = np.zeros((r, k, k)), np.empty((strips, STRIP, r, k))
    for t in range(STRIP - 1, -1, -1):
        on, move = real[:, t], models.moves(strips, is_first and t == 0)
        ahead = rows[:, t] * w
        both, _ = _scaled(alpha[:, t, :, :, None] * move * ahead[:, :, None, :], (2, 3))
        states[:, t] = both.sum(2)
        moves += both[on].sum(0) - (both[0] if is_first and t == 0 else 0.0)  # nothing moves into the first row
        back, _ = _scaled((move @ ahead[..., None])[..., 0], (2,))
        w = np.where(on[:, None, None], back, w)
    g = states.reshape(-1, r, k)[: len(x)]
    sums, squares = np.einsum("nrk,nd->rkd", g, x), np.einsum("nrk,nd->rkd", g, x * x)
    start = g[0] if is_first else np.zeros((r, k))
    return np.concatenate([v.reshape(r, -1) for v in (moves, g.sum(0), sums, squares, start, likelihood + top.sum(0))], 1)


class _Series:
    """One ordered series as blocks on the executors; only sums and one small matrix per block come to the driver."""

    def __init__(self, df: DataFrame, order: Sequence[str], features: Sequence[str]) -> None:
        self.d, d = len(features), len(features)

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, kept, seq = TaskContext.get().partitionId(), np.empty((0, d)), 0
            for pdf in batches:
                kept = np.concatenate([kept, pdf.to_numpy(float)])
                while len(kept) >= BLOCK:
                    yield pd.DataFrame({"part": [part], "seq": [seq], "n": [BLOCK], "x": [kept[:BLOCK].ravel()]})
                    kept, seq = kept[BLOCK:], seq + 1
            if len(kept):
                yield pd.DataFrame({"part": [part], "seq": [seq], "n": [len(kept)], "x": [kept.ravel()]})

        rows = df.select(*order, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=list(features))
        rows = rows.where(reduce(lambda p, q: p & q, [~F.isnan(f) for f in features])).orderBy(*order)
        self.blocks = rows.select(*features).mapInPandas(pack, "part int, seq int, n int, x array<double>").persist()
        sizes = self.blocks.select("part", "seq", "n").orderBy("part", "seq").collect()
        ends = np.cumsum([r.n for r in sizes]) if sizes else np.zeros(0, int)
        self.first = {(r.part, r.seq): int(e - r.n) for r, e in zip(sizes, ends, strict=True)}
        self.n = int(ends[-1]) if sizes else 0

    def each(self, of: Callable[[int, np.ndarray], list[tuple[int, np.ndarray]]]) -> list[tuple[int, np.ndarray]]:
        """Numbers that ``of`` makes of a block (place of its first row, its rows), with their keys."""
        first, d = self.first, self.d

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, seq, x in zip(pdf["part"], pdf["seq"], pdf["x"], strict=True):
                    made = of(first[part, seq], np.asarray(x, float).reshape(-1, d))
                    if made:
                        yield pd.DataFrame({"key": [k for k, _ in made], "v": [v.ravel() for _, v in made]})

        return sorted(((r.key, np.array(r.v)) for r in self.blocks.mapInPandas(run, "key long, v array<double>").collect()), key=lambda kv: kv[0])

    def total(self, of: Callable[[int, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum of ``of`` over all blocks."""
        first, d = self.first, self.d

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found, any_block = np.zeros(size), False
            for pdf in batches:
                any_block = any_block or len(pdf) > 0
                for part, seq, x in zip(pdf["part"], pdf["seq"], pdf["x"], strict=True):
                    found += of(first[part, seq], np.asarray(x, float).reshape(-1, d)).ravel()
            if any_block:
                yield pd.DataFrame({"v": [found]})

        return sum((np.array(r.v) for r in self.blocks.mapInPandas(run, "v array<double>").collect()), np.zeros(size))

    def chained(self, models: _Restarts, lo: int, hi: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """What stands before and after each block of the rows lo to hi, and their log likelihood."""
        r, k = models.start.shape

        def passing(at: int, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
            x = x[max(lo - at, 0) : max(hi - at, 0)]
            if not len(x):
                return []
            b, top = models.density(x)
            m, scale = _passes(models, b, at <= lo)
            whole, z = m[0], scale.sum(0) + top.sum(0)
            for u in range(1, len(m)):
                whole, more = _scaled(whole @ m[u], (1, 2))
                z = z + more
            return [(max(at, lo), np.concatenate([whole.ravel(), z]))]

        found = self.each(passing)
        m = np.array([v[: r * k * k].reshape(r, k, k) for _, v in found])
        before, after, total = _chain(m, np.array([v[r * k * k :] for _, v in found]), np.full((r, k), 1 / k), np.ones((r, k)))
        return {at: (p, q) for (at, _), p, q in zip(found, before, after, strict=True)}, total


def _first_centres(series: _Series, k: int, restarts: int, rows: int) -> np.ndarray:
    """Random rows of each restart, moved to the means of the rows nearest to them until they stand."""
    chosen = np.stack([np.random.default_rng(seed).choice(rows, k, replace=False) for seed in range(restarts)])
    wanted = np.unique(chosen)
    at = dict(series.each(lambda first, x: [(int(i), x[i - first]) for i in wanted[(wanted >= first) & (wanted < first + len(x))]]))
    centres, d = np.array([[at[i] for i in c] for c in chosen]), series.d

    def sums(first: int, x: np.ndarray) -> np.ndarray:
        x = x[: max(rows - first, 0)]
        near = ((x[:, None, None, :] - centres[None]) ** 2).sum(3).argmin(2)[:, :, None] == np.arange(k)
        return np.concatenate([near.sum(0)[:, :, None], np.einsum("nrk,nd->rkd", near.astype(float), x)], 2)

    for _ in range(300):
        got = series.total(sums, restarts * k * (1 + d)).reshape(restarts, k, 1 + d)
        moved = np.where(got[:, :, :1] > 0, got[:, :, 1:] / np.maximum(got[:, :, :1], 1), centres)
        still = np.abs(moved - centres).max() <= 1e-9 * (1 + np.abs(centres).max())
        centres = moved
        if still:
            break
    return centres


def train(
    series: DataFrame | pd.DataFrame, features: Sequence[str], k: int, spark, order: Sequence[str] = (), restarts: int = 10, validation: float = 0.2,  # noqa: ANN001
    rounds: int = 300, tolerance: float = 1e-3, sticky: float = 10.0, floor: float = 1e-3, warm: Gaussians | None = None,
) -> Gaussians:
    """The restart with the best likelihood of the held-out tail; with ``warm`` the one training that starts from that model's parameters.

    ``series`` is one entity's rows, in the order of ``order`` (a pandas frame: as it stands); rows with a missing feature are
    left out. The rows stay on the executors as ordered blocks. A round of expectation maximisation takes two passes over all
    training rows for all restarts at once: the blocks' transition matrices, which the driver chains, and the expected counts.
    A restart ends when its log likelihood grows by less than ``tolerance``. Transitions have a prior that favours staying.
    """
    if isinstance(series, pd.DataFrame):
        series, order = spark.createDataFrame(series[list(features)].assign(_i=np.arange(len(series)))), ["_i"]
    rows = _Series(series, order, features)
    try:
        cut, d = int(rows.n * (1 - validation)), rows.d
        if cut < k:
            raise ValueError(f"{rows.n} rows are too few to train {k} states")
        if warm is not None and (warm.means.shape != (k, d)):
            raise ValueError(f"the model to start from has {warm.means.shape[0]} states of {warm.means.shape[1]} features")
        restarts = 1 if warm is not None else restarts
        centres = warm.means[None] if warm is not None else _first_centres(rows, k, restarts, cut)
        spread = rows.total(lambda at, x: np.concatenate([(y := x[: max(cut - at, 0)]).sum(0), (y * y).sum(0)]), 2 * d) / cut
        variance = np.maximum(spread[d:] - spread[:d] ** 2, 0.0) + floor
        move = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
        models = _Restarts(np.full((restarts, k), 1 / k), np.tile(move, (restarts, 1, 1)), centres, np.tile(variance, (restarts, k, 1)))
        if warm is not None:
            models = _Restarts(*(np.array(v[None], float) for v in (warm.start, warm.move, warm.means, warm.variances)))
        one_block = sum(at < cut for at in rows.first.values()) == 1
        last, active = np.full(restarts, -np.inf), np.arange(restarts)
        for _ in range(rounds):
            new = _one_round(rows, models.some(active), cut, one_block, sticky, floor)
            for have, got in zip((models.start, models.move, models.means, models.variances), (new[0].start, new[0].move, new[0].means, new[0].variances), strict=True):
                have[active] = got
            grown, last[active] = new[1] - last[active], new[1]
            active = active[grown >= tolerance]
            if not len(active):
                break
        else:
            warnings.warn(f"{len(active)} of {restarts} restarts did not converge in {rounds} rounds", stacklevel=2)
        held = rows.chained(models, cut, rows.n)[1] if cut < rows.n else last
        return models.one(int(np.argmax(held)))
    finally:
        rows.blocks.unpersist()


def _one_round(series: _Series, models: _Restarts, cut: int, one_block: bool, sticky: float, floor: float) -> tuple[_Restarts, np.ndarray]:
    """The models after one round over the rows before ``cut``, and the log likelihoods of those before it."""
    (r, k), d = models.start.shape, series.d
    alone = (np.full((r, k), 1 / k), np.ones((r, k)))
    around = {} if one_block else series.chained(models, 0, cut)[0]
    size = k * k + k + 2 * k * d + k + 1

    def counts(at: int, x: np.ndarray) -> np.ndarray:
        x = x[: max(cut - at, 0)]
        return _expected(models, x, *around.get(at, alone), at == 0) if len(x) else np.zeros((r, size))

    got = series.total(counts, r * size).reshape(r, size)
    moves, n, sums, squares, start, likelihood = np.split(got, np.cumsum([k * k, k, k * d, k * d, k]), axis=1)
    moves = moves.reshape(r, k, k) + sticky * np.eye(k) + 0.1
    means, square = sums.reshape(r, k, d) / (n[:, :, None] + 1e-9), squares.reshape(r, k, d) / (n[:, :, None] + 1e-9)
    start = start + 1e-6
    return _Restarts(start / start.sum(1, keepdims=True), moves / moves.sum(2, keepdims=True), means, np.maximum(square - means**2, floor)), likelihood[:, 0]


def relabelled(model: Gaussians, feature: int) -> tuple[Gaussians, list[int]]:
    """States ordered by their mean of one feature, so that labels mean the same after each training."""
    order = list(np.argsort(model.means[:, feature], kind="stable"))
    return model.reordered(order), order


def pressure_medians(df: DataFrame, state: str, long_side: str, short_side: str) -> DataFrame:
    """By state: rows, medians of the total, of short less long, of both sides and of the short share, the mean of the difference, the total's 0.9 quantile."""
    l, s = F.col(long_side).cast("double"), F.col(short_side).cast("double")
    good = df.select(F.col(state).alias("state"), finite(l).alias("l"), finite(s).alias("s")).dropna()
    middle = lambda x, name: F.percentile(x, 0.5).alias(name)
    total, lean = F.col("l") + F.col("s"), F.col("s") - F.col("l")
    return good.groupBy("state").agg(
        F.count("*").alias("n"), middle(total, "total_med"), F.percentile(total, 0.9).alias("total_p90"), middle(lean, "short_dom_med"), F.avg(lean).alias("short_dom_mean"), middle("l", "long_med"), middle("s", "short_med"), middle(F.col("s") / (total + EPS), "short_share_med")
    )


def neutral_first(summary: DataFrame) -> DataFrame:
    """The states of ``pressure_medians`` with ``new_state`` (from 1): the one whose median difference is nearest to 0 stands in the middle, the others
    around it from the most upward to the most downward; ``short_side_ok``: whether the sign of the difference fits the place; ``share`` of the rows."""
    every = Window.partitionBy()  # one row for each state of a model
    nearest = F.row_number().over(Window.orderBy(F.abs("short_dom_med"), "total_med", "state"))
    out = summary.withColumn("_near", nearest == 1).withColumn("_k", F.count("*").over(every))
    middle = F.floor((F.col("_k") - 1) / 2)
    place = F.row_number().over(Window.partitionBy("_near").orderBy(F.desc("short_dom_med"), F.desc("total_med"), "state"))
    out = out.withColumn("new_state", F.when(F.col("_near"), middle + 1).otherwise(place + F.when(place > middle, 1).otherwise(0)).cast("int"))
    fits = F.when(F.col("new_state") <= middle, F.col("short_dom_med") > 0).when(F.col("new_state") > middle + 1, F.col("short_dom_med") < 0).otherwise(F.lit(True))
    return out.withColumns({"sign_ok": fits, "share": F.col("n") / F.sum("n").over(every)}).drop("_near", "_k")


def relabelled_by_medians(model: Gaussians, states: DataFrame, state: str, long_side: str, short_side: str) -> tuple[Gaussians, list[int]]:
    """The model with its states in the order of ``neutral_first`` over rows that it has labelled (states from 0), and the old state of each new one.

    States that no row has keep their order after the others of the downward side."""
    found = {r.new_state: r.state for r in neutral_first(pressure_medians(states, state, long_side, short_side)).collect()}  # one row for each state
    order = [int(found[k]) for k in sorted(found)]
    order += [k for k in range(len(model.start)) if k not in order]
    return model.reordered(order), order
