"""Versioned folders: what is written becomes current by one empty marker file, made last, so that a failed attempt changes nothing.

``path/_published/000000000007`` says that version 7 is current. Recursive feature tables keep their rows and the state after each key's
last row by version; the next append goes on from that state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys
from chronoloom.operators import scans


def _files(spark: SparkSession, path: str):  # noqa: ANN202 - the store's own handle
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> int:
    """The version that is current; 0 before the first."""
    folder, fs = _files(spark, f"{path}/_published")
    return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0


def publish(spark: SparkSession, path: str, version: int) -> None:
    """Make a version current; an error if another writer has published as high a one meanwhile."""
    marker, fs = _files(spark, f"{path}/_published/{version:012d}")
    if current(spark, path) >= version:
        raise ValueError(f"version {version} of {path} is not newer than the current one")
    fs.create(marker, False).close()


def append_scan(spark: SparkSession, df: DataFrame, path: str, keys: Keys, order: Sequence[str], parts: Sequence[scans.Recurrence], chunk: int | None = None) -> int:
    """Adds the rows later than their key's last one, with the recurrences' outputs, as if all rows had been scanned at once; the version that is current then.

    Rows of the table stay as they are: what arrives at or before a key's last time is left out."""
    now = current(spark, path)
    states = spark.read.parquet(f"{path}/states/{now}") if now else None
    fresh = scans.later(df, states, keys, order[0]) if now else df
    if fresh.isEmpty():
        return now
    scans.scan(fresh, keys, order, parts, chunk=chunk, states=states).write.mode("overwrite").parquet(f"{path}/rows/version={now + 1}")
    scans.last_states(fresh, keys, order, parts, chunk=chunk, states=states).write.mode("overwrite").parquet(f"{path}/states/{now + 1}")
    publish(spark, path, now + 1)
    return now + 1


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions up to the current one."""
    return spark.read.parquet(f"{path}/rows").where(F.col("version") <= current(spark, path)).drop("version")
