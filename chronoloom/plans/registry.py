"""Registration of queries together with the SQL that states their result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few decimals, without negative zeros, so that results of two engines can be compared."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def r(*names: str, digits: int = 6) -> str:
    """SQL that rounds columns the way ``rounded`` does."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type: k, t, open, high, low, close, total, n."""
    from chronoloom.operators.resample import ohlc

    return ohlc(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "hour", tie="event_id").withColumnRenamed("event_type", "k")


BARS = """bars AS (SELECT event_type AS k, date_trunc('hour', ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS total, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series with two opposed sides: t, fl (sum of click values), fs (sum of view values), price."""
    events = table(spark, sf_dir, "events")
    side = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(
        side("click").alias("fl"), side("view").alias("fs"), F.max_by("value", F.struct("ts", "event_id")).alias("price")
    ).withColumn("k", F.lit("all"))


FLOWS = """flows AS (SELECT date_trunc('hour', ts) AS t, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS fl,
  sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS fs, arg_max(value, (ts, event_id)) AS price, 'all' AS k FROM events GROUP BY 1)"""
