"""Gaps and islands: runs of equal values, fills, counters and episodes, as ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys, ordered, past, running


def island_id(df: DataFrame, keys: Keys, ts: str, value: Column | str, out: str = "island") -> DataFrame:
    """Number of the run of equal values that a row is in; the first row counts as a change."""
    v = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_c", F.when(v.eqNullSafe(F.lag(v).over(ordered(keys, ts))) & (F.row_number().over(ordered(keys, ts)) > 1), 0).otherwise(1))
    return df.withColumn(out, F.sum("_c").over(running(keys, ts))).drop("_c")


def run_length(df: DataFrame, keys: Keys, ts: str, value: Column | str, out: str) -> DataFrame:
    """1-based position within the current run of equal values."""
    df = island_id(df, keys, ts, value, "_i")
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_i").orderBy(ts))).drop("_i")


def last_matching(x: Column, condition: Column, keys: Keys, ts: str, including: bool = False) -> Column:
    """The latest value that met a condition, before the current row or up to it."""
    return F.last(F.when(condition, x), True).over(running(keys, ts) if including else past(keys, ts))


def entry_counter(df: DataFrame, keys: Keys, ts: str, state: str, out: str) -> DataFrame:
    """Entries into the current non-zero side since the other side was last seen; 0 in neutral rows."""
    s = F.col(state)
    df = df.withColumn("_entry", F.when((s != 0) & ~s.eqNullSafe(F.lag(s).over(ordered(keys, ts))), 1).otherwise(0))
    df = df.withColumn("_side", last_matching(s, s != 0, keys, ts, including=True))
    df = island_id(df, keys, ts, "_side", "_super")
    n = F.sum("_entry").over(Window.partitionBy(*keys, "_super").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(s != 0, n).otherwise(0)).drop("_entry", "_side", "_super")


def rows_since(df: DataFrame, keys: Keys, ts: str, event: Column, out: str) -> DataFrame:
    """Rows since the last event strictly before the current row; NULL before the first."""
    df = df.withColumn("_rn", F.row_number().over(ordered(keys, ts))).withColumn("_e", event)
    return df.withColumn(out, F.col("_rn") - F.last(F.when(F.col("_e"), F.col("_rn")), True).over(past(keys, ts))).drop("_rn", "_e")


def longest_run(df: DataFrame, keys: Keys, ts: str, condition: Column, out: str) -> DataFrame:
    """Per key the length of the longest run in which a condition holds."""
    marked = island_id(df.withColumn("_p", F.coalesce(condition, F.lit(False))), keys, ts, "_p", "_i")
    runs = marked.groupBy(*keys, "_i", "_p").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_p"), F.col("_n"))), F.lit(0)).alias(out))


def segments(df: DataFrame, keys: Keys, ts: str, value: str) -> DataFrame:
    """Episodes of equal values: start, end, number of rows, and start of the next one."""
    runs = island_id(df, keys, ts, value, "_i").groupBy(*keys, "_i", value).agg(F.min(ts).alias("seg_start"), F.max(ts).alias("seg_end"), F.count("*").alias("n_rows"))
    return runs.withColumn("next_start", F.lead("seg_start").over(Window.partitionBy(*keys).orderBy("seg_start"))).drop("_i")


def state_exit(state: str, keys: Keys, ts: str, n: int) -> Column:
    """Label, looks ahead: whether another state follows within the next n rows."""
    w = ordered(keys, ts).rowsBetween(1, n)
    return F.coalesce((F.min(state).over(w) != F.col(state)) | (F.max(state).over(w) != F.col(state)), F.lit(False))


def modal_segments(df: DataFrame, keys: Keys, ts: str, value: str, bucket: int) -> DataFrame:
    """Buckets of so many rows reduced to their most frequent value (the smallest on ties), then runs of equal buckets."""
    df = df.withColumn("_b", F.floor((F.row_number().over(ordered(keys, ts)) - 1) / bucket))
    counts = df.groupBy(*keys, "_b", value).agg(F.count("*").alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    modes = counts.groupBy(*keys, "_b").agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("_n"))
    runs = island_id(modes, keys, "_b", "mode", "_i")
    return runs.groupBy(*keys, "_i", "mode").agg(F.min("_lo").alias("seg_start"), F.max("_hi").alias("seg_end"), F.sum("_n").alias("n_rows")).drop("_i")
