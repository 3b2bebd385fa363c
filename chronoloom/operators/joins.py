"""Joins on time and on buckets: label lookup, overlay of accepted history, gaps, folds, thresholds, hierarchical fallback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast table may have. Tables of folds and thresholds hold numbers and times, so this bounds their bytes too.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table that a count has shown to be small; otherwise leave the choice to the optimiser, which goes by bytes."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def time_join(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """N-way equi-join on keys and time."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def label_lookup(df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: Column, out: str) -> DataFrame:
    """Label, looks ahead: the value at exactly ``ts + horizon``, NULL if there is none."""
    ahead = df.select(*keys, (F.col(ts) - horizon).alias(ts), F.col(value).alias(out))
    return df.join(ahead, [*keys, ts], "left")


def overlay(current: DataFrame, reference: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Where the reference has the key, its columns replace the current ones, NULLs included."""
    ref = reference.select(*on, F.lit(True).alias("_has"), *[F.col(c).alias(f"_ref_{c}") for c in columns])
    joined = current.join(ref, list(on), "left")
    return joined.select(*[F.when(F.col("_has"), F.col(f"_ref_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def missing_times(df: DataFrame, keys: Sequence[str], ts: str, step: Column) -> DataFrame:
    """Times of the regular grid between a key's first and last row at which it has no row."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(ts))
    return grid.join(df.select(*keys, ts).distinct(), [*keys, ts], "left_anti")


def fold_members(df: DataFrame, folds: DataFrame, ts: str) -> DataFrame:
    """Rows of each fold: start <= t < end. The fold table is small and broadcast, so this is a map-side range join."""
    return df.join(small(folds), (F.col("fold_start") <= F.col(ts)) & (F.col(ts) < F.col("fold_end")))


def with_thresholds(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """A one-row table of thresholds beside every row."""
    return df.crossJoin(F.broadcast(scalars.limit(1)))


def fallback_lookup(df: DataFrame, stats: Sequence[tuple[Sequence[str], DataFrame]], value: str, count: str, least: int, out: str) -> DataFrame:
    """The value of the first bucket level with at least ``least`` observations; the last level needs none.

    Each level is one join with an aggregate by its bucket columns (no columns: one row for all).
    """
    picks = []
    for k, (columns, table) in enumerate(stats):
        renamed = table.select(*columns, F.col(value).alias(f"_v{k}"), F.col(count).alias(f"_n{k}"))
        df = df.join(renamed, list(columns), "left") if columns else df.crossJoin(F.broadcast(renamed.limit(1)))
        picks.append(F.col(f"_v{k}") if k == len(stats) - 1 else F.when(F.col(f"_n{k}") >= least, F.col(f"_v{k}")))
    return df.withColumn(out, F.coalesce(*picks)).drop(*[f"_{x}{k}" for k in range(len(stats)) for x in "vn"])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; of a key in both the new row stays."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)


def append_newer(cache: DataFrame, source: DataFrame, ts: str) -> DataFrame:
    """An incremental table: of the source only rows later than the cache's last time are added."""
    mark = cache.agg(F.max(ts).alias("_mark"))
    fresh = source.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")
    return cache.unionByName(fresh)
