"""Bars and clocks: resampling, last row of a time, collapse to the clock on which a feature becomes usable."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _at(ts: str, tie: str | None) -> Column:
    return F.struct(ts, tie) if tie else F.col(ts)


def ohlc(df: DataFrame, keys: Sequence[str], ts: str, value: str, unit: str = "hour", tie: str | None = None) -> DataFrame:
    """Bars of a value by calendar unit; partial aggregation runs before the only shuffle."""
    at = _at(ts, tie)
    return df.groupBy(*keys, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("t")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.sum(value).alias("total"), F.count("*").alias("n"),
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the given order; a struct aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    best = F.max(F.struct(*lead, *[c for c in rest if c not in lead])).alias("_r")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def collapse_to_source(df: DataFrame, keys: Sequence[str], source_ts: str, ts: str) -> DataFrame:
    """One row, the latest, of each source time."""
    return keep_last(df.where(F.col(source_ts).isNotNull()), [*keys, source_ts], [ts])


def chronological_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``split`` by row position: the first floor(n train) rows, up to floor(n (train + validation)), the rest.

    Shares are taken as the decimals they are written as: in doubles 179460 * 0.7 is just below 125622."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    rn = F.row_number().over(w.orderBy(*order))
    upto = Decimal(str(train)), Decimal(str(train)) + Decimal(str(validation))
    a, b = (F.floor(n.cast("decimal(18,0)") * F.lit(share)) for share in upto)
    return df.withColumn("split", F.when(rn <= a, "train").when(rn <= b, "validation").otherwise("test"))
