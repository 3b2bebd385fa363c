"""Sinks: Parquet and CSV feature tables, incremental tables, run history, model parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.reviews import as_markdown


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV by the path's ending (ISO times, empty for NULL)."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if path.endswith((".csv", ".csv.gz")):
        writer.options(header=True, nullValue="", emptyValue="", compression="gzip" if path.endswith(".gz") else "none").csv(path)
    else:
        writer.parquet(path)


def compact_numbers(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles as short text, NULL stays NULL: the form of a small CSV."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}g", F.col(c))).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def append_newer(spark: SparkSession, df: DataFrame, path: str, ts: str) -> int:
    """Adds to a Parquet table the rows later than its last time; the number of rows added."""
    try:
        mark = spark.read.parquet(path).agg(F.max(ts)).first()[0]
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        mark = None
    fresh = df if mark is None else df.where(F.col(ts) > F.lit(mark))
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def append_history(spark: SparkSession, row: dict, path: str) -> None:
    """One more line of a run history."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").json(path)


def save_parameters(spark: SparkSession, parameters: dict[str, list[float]], path: str) -> None:
    """Model parameters as plain columns, never as pickled objects."""
    spark.createDataFrame(list(parameters.items()), "name string, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, list[float]]:
    return {r.name: list(r.value) for r in spark.read.parquet(path).collect()}


def write_catalogue(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small table of names (a feature catalogue, a run's summary) as ``path/json`` and ``path/markdown``, one file each."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(f"{path}/json")
    as_markdown(df, order).orderBy("i").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
