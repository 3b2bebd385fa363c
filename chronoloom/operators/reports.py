"""Data behind reports: overviews, filters on clocks, correlations, staleness, box statistics, examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.frames import Keys, rows
from chronoloom.functions.scalar import finite, micros


def overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, NULLs, distinct values, smallest and largest as text; one pass over the table."""
    per = [x for k, c in enumerate(columns) for x in (F.sum(F.col(c).isNull().cast("long")).alias(f"n{k}"), F.approx_count_distinct(c).alias(f"d{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}"))]
    one = df.agg(F.count("*").alias("n_rows"), *per)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n_null"), F.col(f"d{k}").alias("about_distinct"), F.col(f"lo{k}").alias("lowest"), F.col(f"hi{k}").alias("highest")) for k, c in enumerate(columns)])
    return one.select("n_rows", F.inline(each))


def trailing(df: DataFrame, ts: str, length: int) -> DataFrame:
    """Rows of the last ``length`` microseconds before the latest row, that row's time included."""
    last = df.agg(F.max(micros(ts)).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(micros(ts) >= F.col("_last") - length).drop("_last")


def matured(df: DataFrame, available: str, clock: DataFrame, ts: str) -> DataFrame:
    """Rows that were available at the clock's last time."""
    last = clock.agg(F.max(ts).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(available) <= F.col("_last")).drop("_last")


def at_source_clock(df: DataFrame, age: str, state: str, states: Sequence) -> DataFrame:
    """Rows on which a feature is new (age 0) and its state valid."""
    return df.where((F.col(age) == 0) & F.col(state).isin(*states))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def correlations(df: DataFrame, columns: Sequence[str], least: int = 2) -> DataFrame:
    """(a, b, n, corr) of all pairs of columns over the rows that have both, in one pass."""
    pairs = list(combinations(columns, 2))
    both = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1) for a, b in pairs]
    one = df.agg(*[x for k, ((a, b), m) in enumerate(zip(pairs, both, strict=True)) for x in (F.count(m).alias(f"n{k}"), F.corr(F.when(m == 1, F.col(a)), F.when(m == 1, F.col(b))).alias(f"c{k}"))])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{k}").alias("n"), F.when(F.col(f"n{k}") >= least, finite(f"c{k}")).alias("corr")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(each))


def high_pairs(corr: DataFrame, least: float, most: int) -> DataFrame:
    """The strongest pairs, a report's top list."""
    return corr.where(F.abs("corr") >= least).orderBy(F.abs("corr").desc(), "a", "b").limit(most)


def staleness(df: DataFrame, ages: Mapping[str, str]) -> DataFrame:
    """Per named age: share of rows with one, median, p90 and p99."""
    stats = [x for k, c in enumerate(ages.values()) for x in (F.avg(F.col(c).isNotNull().cast("double")).alias(f"s{k}"), F.percentile(c, [0.5, 0.9, 0.99]).alias(f"q{k}"))]
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{k}").alias("share"), *[F.get(f"q{k}", F.lit(j)).alias(q) for j, q in enumerate(("p50", "p90", "p99"))]) for k, n in enumerate(ages)])
    return df.agg(*stats).select(F.inline(each))


def range_rates(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per column the share of its values outside of an expected range."""
    out = [F.avg(F.when(F.col(c).isNotNull(), (~F.col(c).between(lo, hi)).cast("double"))).alias(f"r{k}") for k, (c, (lo, hi)) in enumerate(ranges.items())]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{k}").alias("outside")) for k, c in enumerate(ranges)])
    return df.agg(*out).select(F.inline(each))


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (1.5 IQR, cut to the data) by group."""
    q = df.groupBy(group).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("q"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    q1, q2, q3 = (F.get("q", F.lit(k)) for k in range(3))
    return q.select(group, "n", q1.alias("q1"), q2.alias("q2"), q3.alias("q3"), F.greatest("lo", q1 - 1.5 * (q3 - q1)).alias("low"), F.least("hi", q3 + 1.5 * (q3 - q1)).alias("high"))


def rolling_missing(x: Column, keys: Keys, ts: str, n: int) -> Column:
    """Share of NULLs among the last n rows."""
    return F.avg(x.isNull().cast("double")).over(rows(keys, ts, n))


def best_examples(df: DataFrame, checks: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """The first row by order that meets each named condition; rows are tagged once, so the table is read once."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    tagged = df.withColumn("example", F.explode(tags))
    rn = F.row_number().over(Window.partitionBy("example").orderBy(*order))
    return tagged.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def coefficient_table(spark, models: Mapping[str, Mapping[str, float]]) -> DataFrame:  # noqa: ANN001
    """Long form of fitted coefficients: horizon, term, value."""
    return spark.createDataFrame([(h, t, float(v)) for h, terms in models.items() for t, v in terms.items()], "horizon string, term string, value double")
