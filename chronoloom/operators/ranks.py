"""Order statistics of sliding frames: one pass over the ordered rows of a key, logarithmic work a row whatever the frame's length.

The values of a frame are held in sorted blocks; a row enters once and leaves once. Frames over time are cut into chunks of a key's
time line, each with the rows before it that its frames reach, so that one long series is the work of many tasks; frames over rows
can be cut likewise, after rows have been numbered without bringing a key together. Times of a key are distinct.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Mapping, Sequence
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys
from chronoloom.functions.scalar import finite, micros
from chronoloom.operators.recursive import ordered_scan

NAN = float("nan")


class Sorted:
    """Numbers in order, in blocks of up to ``2 * SIZE``."""

    SIZE = 512

    def __init__(self) -> None:
        self.blocks: list[array] = []
        self.tops: list[float] = []
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks.append(array("d", [x]))
            self.tops.append(x)
            return
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.tops[k] = block[-1]
        if len(block) > 2 * self.SIZE:
            self.blocks[k : k + 1] = [block[: self.SIZE], block[self.SIZE :]]
            self.tops[k : k + 1] = [block[self.SIZE - 1], block[-1]]

    def remove(self, x: float) -> None:
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        self.n -= 1
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def _count(self, x: float, side: Callable) -> int:
        k = side(self.tops, x)
        below = sum(map(len, self.blocks[:k]))
        return below + side(self.blocks[k], x) if k < len(self.blocks) else below

    def below(self, x: float) -> int:
        return self._count(x, bisect_left)

    def upto(self, x: float) -> int:
        return self._count(x, bisect_right)

    def at(self, i: int) -> float:
        for block in self.blocks:
            if i < len(block):
                return block[i]
            i -= len(block)
        raise IndexError

    def quantile(self, q: float) -> float:
        """Linear interpolation between neighbours."""
        place = (self.n - 1) * q
        lo = floor(place)
        a = self.at(lo)
        return a if place == lo else a + (self.at(lo + 1) - a) * (place - lo)


class Frame:
    """The rows of a sliding frame: those whose place is above the current one minus ``size``."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.values = size, deque(), Sorted()

    def evict(self, at: int) -> None:
        while self.held and self.held[0][0] <= at - self.size:
            x = self.held.popleft()[1]
            if x == x:
                self.values.remove(x)

    def add(self, at: int, x: float) -> None:
        self.held.append((at, x))
        if x == x:
            self.values.add(x)

    def slide(self, at: int, x: float) -> Sorted:
        self.evict(at)
        self.add(at, x)
        return self.values


#: (state, place of the row, its values) -> the row's results
Each = Callable[..., Sequence[float]]


def numbered(df: DataFrame, keys: Keys, ts: str, width: int, out: str) -> DataFrame:
    """Row numbers from 0 by key in order of time: numbers within buckets of ``width`` microseconds, plus the rows of the buckets before."""
    bucket = F.floor(micros(ts) / width)
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))  # one row for each bucket
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(ts)) - 1
    return df.withColumn("_within", within).join(sizes, [*keys, "_bucket"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")


def in_chunks(df: DataFrame, keys: Keys, place: str, back: int, width: int) -> DataFrame:
    """Every row in the chunk of its place (``_chunk``, ``_own`` true) and in the later chunks whose frames reach back to it.

    Any operator whose frames reach at most ``back`` places back gives the same rows by keys and ``_chunk`` as by keys alone, once
    the rows that aren't ``_own`` are left out.
    """
    first = F.floor(F.col(place) / width)
    rows = df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col(place) + back) / width))))
    return rows.withColumn("_own", F.col("_chunk") == first)


def sliding(
    df: DataFrame, keys: Keys, ts: str, value: str | Sequence[str], outputs: Sequence[str], state: Callable[[], object], each: Each, *, rows: int | None = None, length: int | None = None, chunk: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Adds the columns ``outputs``, made by ``each`` row by row. The frames reach ``rows`` rows or ``length`` microseconds back.

    ``chunk`` is the width of a chunk: four frames if not given for frames over time; frames over rows are cut only where it and the
    width of the ``buckets`` for numbering are given. Without either length the state is carried over the whole series.
    """
    columns = df.columns
    values = [value] if isinstance(value, str) else list(value)
    df = df.withColumns({f"_x{k}": F.col(v).cast("double") for k, v in enumerate(values)})
    cut = False
    if length is not None:
        df = df.withColumn("_at", micros(ts))
        df, cut = in_chunks(df, keys, "_at", length, chunk or 4 * length), True
    elif rows is not None and chunk and buckets:
        df, cut = in_chunks(numbered(df, keys, ts, buckets, "_at"), keys, "_at", rows, chunk), True
    by_rows = "_at" not in df.columns

    def step(held: object, part: pd.DataFrame) -> tuple[dict[str, np.ndarray], object]:
        own, seen = held if held is not None else (state(), 0)
        at = range(seen, seen + len(part)) if by_rows else part["_at"].tolist()
        done = np.array([each(own, *x) for x in zip(at, *(part[f"_x{k}"].to_numpy(float).tolist() for k in range(len(values))), strict=True)], float).reshape(len(part), len(outputs))
        return {c: done[:, k] for k, c in enumerate(outputs)}, (own, seen + len(part))

    found = ordered_scan(df, [*keys, "_chunk"] if cut else keys, [ts], step, ", ".join(f"`{c}` double" for c in outputs))
    if cut:
        found = found.where("_own")
    return found.select(*columns, *[finite(c).alias(c) for c in outputs])


def rolling_quantiles(df: DataFrame, keys: Keys, ts: str, value: str, quantiles: Mapping[str, float], *, least: int = 1, rows: int | None = None, length: int | None = None, **cut: int) -> DataFrame:
    """Several quantiles of the last ``rows`` rows or of the span (t - length, t], where it holds ``least`` values."""
    qs, size = list(quantiles.values()), rows or length

    def each(f: Frame, at: int, x: float) -> list[float]:
        v = f.slide(at, x)
        return [v.quantile(q) for q in qs] if len(v) >= max(least, 1) else [NAN] * len(qs)

    return sliding(df, keys, ts, value, list(quantiles), lambda: Frame(size), each, rows=rows, length=length, **cut)


def past_ranks(df: DataFrame, keys: Keys, ts: str, value: str, length: int, least: int, out: str, strict: bool) -> DataFrame:
    """Place of a value among those of (t - length, t] as (average rank - 1) / (count - 1), or (``strict``) its mid-rank among
    those of [t - length, t)."""

    def within(f: Frame, at: int, x: float) -> tuple[float]:
        v = f.slide(at, x)
        n = len(v)
        return ((v.below(x) + (v.upto(x) - v.below(x) - 1) / 2) / (n - 1),) if x == x and n >= max(least, 2) else (NAN,)

    def before(f: Frame, at: int, x: float) -> tuple[float]:
        return (midrank(f, at, x, least),)

    return sliding(df, keys, ts, value, [out], lambda: Frame(length + 1 if strict else length), before if strict else within, length=length + 1 if strict else length)


def past_midranks(df: DataFrame, keys: Keys, ts: str, values: Mapping[str, str], length: int, least: int) -> DataFrame:
    """Mid-ranks (output: value) among the values of [t - length, t), all in one pass."""

    def each(frames: list[Frame], at: int, *xs: float) -> list[float]:
        return [midrank(f, at, x, least) for f, x in zip(frames, xs, strict=True)]

    return sliding(df, keys, ts, list(values.values()), list(values), lambda: [Frame(length + 1) for _ in values], each, length=length + 1)


def midrank(f: Frame, at: int, x: float, least: int) -> float:
    """Mid-rank of x among the frame's earlier values, which it then joins."""
    f.evict(at)
    v = f.values
    found = (v.below(x) + v.upto(x)) / (2 * len(v)) if x == x and len(v) >= max(least, 1) else NAN
    f.add(at, x)
    return found


def past_quantiles(df: DataFrame, keys: Keys, ts: str, value: str, quantiles: Mapping[str, float], length: int, least: int) -> DataFrame:
    """Quantiles of the values of the rows before, each standing at the row after it, over the span (t - length, t]."""
    qs = list(quantiles.values())
    df = df.withColumn("_before", F.lag(value).over(Window.partitionBy(*keys).orderBy(ts)))

    def each(f: Frame, at: int, x: float) -> list[float]:
        v = f.slide(at, x)
        return [v.quantile(q) for q in qs] if len(v) >= max(least, 1) else [NAN] * len(qs)

    return sliding(df, keys, ts, "_before", list(quantiles), lambda: Frame(length), each, length=length).drop("_before")


def span_context(df: DataFrame, keys: Keys, ts: str, length: int, least: int, ranks: Mapping[str, str], robust: Mapping[str, str], eps: float = 1e-12, bound: float = 5.0) -> DataFrame:
    """One pass for many columns over (t - length, t]: ``ranks`` (output: value) by (average rank - 1) / (count - 1); ``robust``
    (output: value) by the distance from the median of the rows before over their interquartile range, clipped."""
    n, m = len(ranks), len(robust)

    def each(frames: list[Frame], at: int, *xs: float) -> list[float]:
        out = []
        for f, x in zip(frames, xs[:n], strict=False):
            v = f.slide(at, x)
            out.append((v.below(x) + (v.upto(x) - v.below(x) - 1) / 2) / (len(v) - 1) if x == x and len(v) >= max(least, 2) else NAN)
        for f, x, before in zip(frames[n:], xs[n : n + m], xs[n + m :], strict=True):
            v = f.slide(at, before)
            known = x == x and len(v) >= max(least, 1)
            out.append(max(-bound, min(bound, (x - v.quantile(0.5)) / (v.quantile(0.75) - v.quantile(0.25) + eps))) if known else NAN)
        return out

    w = Window.partitionBy(*keys).orderBy(ts)
    before = {f"_before{k}": F.lag(v).over(w) for k, v in enumerate(robust.values())}
    values = [*ranks.values(), *robust.values(), *before]
    return sliding(df.withColumns(before), keys, ts, values, [*ranks, *robust], lambda: [Frame(length) for _ in range(n + m)], each, length=length).drop(*before)


def nested_deviation(df: DataFrame, keys: Keys, ts: str, value: str, n: int, least: int, median: str, deviation: str) -> DataFrame:
    """The median of the last n rows, and the median of the last n distances from the median at their row, in one pass."""

    def each(s: tuple[Frame, Frame], at: int, x: float) -> tuple[float, float]:
        v = s[0].slide(at, x)
        med = v.quantile(0.5) if len(v) >= max(least, 1) else NAN
        d = s[1].slide(at, abs(x - med))
        return med, d.quantile(0.5) if len(d) >= max(least, 1) else NAN

    return sliding(df, keys, ts, value, [median, deviation], lambda: (Frame(n), Frame(n)), each, rows=n)


def expanding_bins(df: DataFrame, keys: Keys, ts: str, value: str, bins: int, first: int, every: int, neutral: int, out: str) -> DataFrame:
    """Quantile bins of strictly past values, refitted every ``every`` rows after the first ``first``. A key's values so far are
    held in order (8 bytes a row)."""
    qs = [k / bins for k in range(1, bins)]

    def each(s: dict, at: int, x: float) -> tuple[float]:
        v = s["v"]
        if at >= first and (at - first) % every == 0:
            s["edges"] = [v.quantile(q) for q in qs] if len(v) else None
        edges = s["edges"]
        if x == x:
            v.add(x)
        return (bisect_right(edges, x) if edges is not None and x == x else neutral,)

    found = sliding(df, keys, ts, value, ["_bin"], lambda: {"v": Sorted(), "edges": None}, each)
    return found.withColumn(out, F.col("_bin").cast("int")).drop("_bin")
