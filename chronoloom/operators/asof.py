"""As-of joins by union and fill: one shuffle on the keys, no range condition, no pair is ever made that is not a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import micros


def asof_join(
    left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], *, right_on: str | None = None,
    offset: int = 0, tolerance: int | None = None, tie: str | None = None, age: str | None = None, strict: bool = False,
) -> DataFrame:
    """Each left row with the values of the latest right row of its key that was available at its time.

    A right row becomes available ``offset`` microseconds after its own time. The tolerance (microseconds) is inclusive; equal
    times match unless ``strict``. Of right rows of one time the last by ``tie`` counts. ``age`` names a column for the age in
    microseconds. Left rows without a match stay, with NULLs.
    """
    right_on = right_on or on
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    avail = micros(right_on) + offset
    r = right.select(*by, avail.alias("_at"), F.struct(avail.alias("_at"), *values).alias("_r"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
    r = r.where(F.col("_at").isNotNull()).withColumn("_side", F.lit(1 if strict else 0))
    l = left.select(*by, micros(on).alias("_at"), F.struct(*left.columns).alias("_l")).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_tie", F.lit(0).cast("long"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    old = F.col("_at") - F.col("_m._at")
    ok = F.lit(True) if tolerance is None else old <= tolerance
    out = [F.col(f"_l.{c}").alias(c) for c in left.columns] + [F.when(ok, F.col(f"_m.{v}")).alias(v) for v in values]
    return filled.select(*out, *([F.when(ok, old).alias(age)] if age else []))


def anchor(df: DataFrame, keys: Sequence[str], ts: str, value: str, back: int, tolerance: int) -> Column:
    """The value at or before ``t - back``, at most ``tolerance`` older: one window, no join."""
    w = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-back - tolerance, -back)
    return F.last(value, ignorenulls=True).over(w)
