"""Top-k, thinning and down-sampling of ordered series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys, ordered


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group (rows beyond n are cut before the shuffle)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def extremes(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n largest and n smallest rows, each row once."""
    top = df.orderBy(F.desc(value), tie).limit(n)
    low = df.orderBy(F.asc(value), tie).limit(n)
    return top.unionByName(low).dropDuplicates([tie])


def every_nth(df: DataFrame, keys: Keys, ts: str, step: int) -> DataFrame:
    rn = F.row_number().over(ordered(keys, ts))
    return df.withColumn("_rn", rn).where((F.col("_rn") - 1) % step == 0).drop("_rn")


def evenly_thinned(df: DataFrame, keys: Keys, ts: str, points: int) -> DataFrame:
    """At most ``points`` rows at even positions of each key's rows, the first and the last among them."""
    w = Window.partitionBy(*keys)
    rn, n = F.row_number().over(ordered(keys, ts)) - 1, F.count("*").over(w)
    df = df.withColumn("_i", rn).withColumn("_n", n)
    # row i is chosen if some k of 0..points-1 has floor(k (n - 1) / (points - 1)) = i
    first = F.ceil(F.col("_i") * (points - 1) / F.when(F.col("_n") > 1, F.col("_n") - 1) - 1e-9)
    hit = (F.floor(first * (F.col("_n") - 1) / (points - 1) + 1e-9) == F.col("_i")) & (first <= points - 1)
    return df.where((F.col("_n") <= points) | hit).drop("_i", "_n")


def min_max_sampled(df: DataFrame, keys: Keys, ts: str, value: str, bucket: int) -> DataFrame:
    """First, last, lowest and highest row of every so many rows, each once, in (key, time, value) form."""
    df = df.withColumn("_b", F.floor((F.row_number().over(ordered(keys, ts)) - 1) / bucket))
    point = F.struct(F.col(ts).alias(ts), F.col(value).alias(value))
    neg = -F.unix_micros(F.col(ts).cast("timestamp"))
    picks = df.groupBy(*keys, "_b").agg(
        F.min_by(point, F.col(ts)).alias("a"), F.max_by(point, F.col(ts)).alias("b"), F.min_by(point, F.struct(F.col(value), F.col(ts))).alias("c"), F.max_by(point, F.struct(F.col(value), neg)).alias("d")
    )
    return picks.select(*keys, F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("p")).select(*keys, f"p.{ts}", f"p.{value}")


def interpolated_at(df: DataFrame, points: DataFrame, keys: Keys, ts: str, value: str, out: str) -> DataFrame:
    """``points`` with a series' value at their times, on the line between the rows around them; NULL outside of the series.

    Each row of the series carries the one after it, so a point needs only the last row before it: one sort and one running frame, no
    frame that is read again for each row.
    """
    at, known = F.unix_micros(F.col(ts).cast("timestamp")), [F.col(c).isNotNull() for c in (*keys, ts)]
    line = df.where(reduce(and_, known)).select(*keys, at.alias("_at"), F.struct(at.alias("t"), F.col(value).alias("v")).alias("_row"))
    line = line.withColumn("_next", F.lead("_row").over(Window.partitionBy(*keys).orderBy("_row")))
    line = line.select(*keys, "_at", F.struct(F.col("_row.t").alias("t"), F.col("_row.v").alias("v"), F.col("_next.t").alias("next_t"), F.col("_next.v").alias("next_v")).alias("_known"))
    asked = points.drop(out).withColumns({"_at": at, "_asked": F.lit(True)})
    both = line.unionByName(asked, allowMissingColumns=True)
    before = F.last("_known", True).over(Window.partitionBy(*keys).orderBy("_at", F.asc_nulls_last("_known")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_known", before).where("_asked")
    t, v, next_t, next_v = (F.col(f"_known.{c}") for c in ("t", "v", "next_t", "next_v"))
    price = F.when(F.col("_at") == t, v).otherwise(v + (next_v - v) * (F.col("_at") - t) / F.nullif(next_t - t, F.lit(0)))
    return both.select(*[c for c in points.columns if c != out], price.alias(out))
