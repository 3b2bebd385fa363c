"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Make sure checkpoints have a folder: the cluster's setting, or in local mode a temporary one where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronoloom-ckpt-"))
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, although the body may name it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: computed once, its columns pruned when read, and not lost
    with an executor."""
    spark = with_checkpoint_dir(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast a narrow table where a count has shown it to be small; else the optimiser chooses, which goes by bytes."""
    return F.broadcast(df) if rows <= limit else df


#: Bits of a digit of ``starts``.
DIGIT_BITS = 10


def starts(counts: DataFrame, keys: Sequence[str], digits: str, n: str, largest: int) -> DataFrame:
    """``counts`` (one row for each ``keys`` and ``digits``, keys not null, digits from 0 to ``largest``) with ``start``: the sum of ``n``
    over the smaller digits of the same keys.

    The histogram is rolled up digit by digit of ``DIGIT_BITS`` bits, and the starts go down again: a start is that of the longer number's
    prefix and the sum over its smaller siblings. A window holds the siblings of one prefix, so no task sees a whole key.
    """
    levels = max(1, -(-largest.bit_length() // DIGIT_BITS))
    tables = [counts]
    for _ in range(levels - 1):
        below = tables[-1].select(*keys, F.shiftright(digits, DIGIT_BITS).alias(digits), n)
        tables.append(below.groupBy(*keys, digits).agg(F.sum(n).alias(n)))
    prefix = [f"_prefix_of_{digits}"]
    siblings = Window.partitionBy(*keys, *prefix).orderBy(digits).rowsBetween(Window.unboundedPreceding, -1)
    above = None
    for level in reversed(tables):
        before = level.withColumn(prefix[0], F.shiftright(digits, DIGIT_BITS)).withColumn("start", F.coalesce(F.sum(n).over(siblings), F.lit(0)))
        if above is not None:
            over = above.select(*keys, F.col(digits).alias(prefix[0]), F.col("start").alias("_above"))
            before = before.join(over, [*keys, *prefix]).withColumn("start", F.col("start") + F.col("_above")).drop("_above")
        above = before.drop(*prefix)
    return above
