"""Aggregations of feature evaluation: bins, profiles, ranks and deciles, correlation, coverage, monitoring, event studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import divide


def bin_statistics(df: DataFrame, level: str, value: str) -> DataFrame:
    """Range, count, centre, spread and shares of a value by bin, with the shares of the bins below and of these and the bin itself."""
    out = df.groupBy(level).agg(
        F.count("*").alias("n"), F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.percentile(value, 0.5).alias("v_median"), F.avg(value).alias("v_mean"), F.stddev_samp(value).alias("v_std")
    )
    total = F.sum("n").over(Window.partitionBy())
    up = F.sum("n").over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))  # one row for each bin
    return out.withColumns({"v_range": F.col("v_max") - F.col("v_min"), "share": F.col("n") / total, "share_low": up / total, "share_below": (up - F.col("n")) / total})


def share_within(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def fixed_domain(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Counts and shares for every member of a domain, zeros included."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    all_rows = df.sparkSession.createDataFrame([(v,) for v in domain], df.select(column).schema)
    out = all_rows.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("share", divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())))


def average_rank(x: Column | str, keys: Sequence[str]) -> Column:
    """Rank with ties at their average; keys must be given, they spread the work."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_rx", average_rank(x, keys)).withColumn("_ry", average_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias(out), F.count("*").alias("n"))


def quantile_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int, out: str) -> DataFrame:
    """Buckets of (almost) equal counts by first-come rank r of n: max(0, ceil((r - 1) buckets / (n - 1)) - 1)."""
    w = Window.partitionBy(*keys)
    r, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    b = F.ceil((r - 1) * float(buckets) / F.when(n > 1, n - 1) - 1e-12) - 1
    return df.withColumn(out, F.coalesce(F.greatest(b, F.lit(0)), F.lit(0)).cast("int"))


def unbiased_skewness(x: str) -> Column:
    """Adjusted Fisher-Pearson skewness from the population's."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def unbiased_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6))


def numeric_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, missing, moments, zero and positive shares in one pass; exact quantiles and the number of distinct values by ``exact_quantiles``."""
    x = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(x.isNull().cast("int")).alias("n_null"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("v_min"), F.max(value).alias("v_max"),
        unbiased_skewness(value).alias("skew"), unbiased_kurtosis(value).alias("kurt"), F.avg((x == 0).cast("double")).alias("zero_share"), F.avg((x > 0).cast("double")).alias("positive_share"),
    )
    q = exact_quantiles(df, keys, [value], {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}).drop("column", "n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys], F.lit(True))
    joined = out.join(q.withColumnsRenamed({k: f"_q_{k}" for k in keys}), same, "left").drop(*[f"_q_{k}" for k in keys])
    return joined.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def with_total(df: DataFrame, group: str, other: Sequence[str], aggregates: Sequence[Column], name: str = "all") -> DataFrame:
    """Aggregates by a column and over all its values, in one pass by grouping sets."""
    other = list(other)
    cube = df.groupingSets([[*map(F.col, [group, *other])], [*map(F.col, other)]], group, *other)
    out = cube.agg(*aggregates, F.grouping(group).alias("_all"))
    return out.withColumn(group, F.when(F.col("_all") == 1, name).otherwise(F.col(group))).drop("_all")


def trailing_monitor(df: DataFrame, ts: str, days: Sequence[int], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over the last so many days before the latest row, for several lengths in one pass."""
    latest = df.agg(F.max(ts).alias("_latest"))
    spans = F.array(*[F.lit(d) for d in days])
    rows = df.crossJoin(F.broadcast(latest)).withColumn("_age", F.unix_micros(F.col("_latest").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
    member = rows.withColumn("days", F.explode(F.filter(spans, lambda d: F.col("_age") <= d.cast("long") * 86_400_000_000)))
    return member.groupBy("days").agg(*aggregates)


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Row-normalised table of two columns, e.g. a transition matrix."""
    counts = df.groupBy(row).pivot(column, list(values)).count().fillna(0)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return counts.select(row, *[(F.col(str(v)) / total).alias(str(v)) for v in values])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins of [low, high]; values outside are left out."""
    b = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    b = F.when(F.col(value) == high, bins).otherwise(b)
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def event_study(df: DataFrame, keys: Sequence[str], ts: str, value: str, event: str, before: int, after: int) -> DataFrame:
    """Median and mean over events of the value by distance in rows, -before..after."""
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)))
    at = df.where(F.col(event)).select(*keys, F.col("_rn").alias("_event"))
    around = at.select(*keys, F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "_event").withColumn("_rn", F.col("_event") + F.col("offset"))
    return around.join(df.select(*keys, "_rn", value), [*keys, "_rn"]).groupBy("offset").agg(F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.count(value).alias("n"))


#: Ranges of a binade in ``value_range``, and the parts that rows without a value are dealt to.
RANGES, SALTS = 1 << 8, 1_024


def value_range(value: Column) -> Column:
    """A long that never falls as the value rises, equal for values of about the same size: sign, exponent and first 8 bits of the fraction.

    A wrong exponent by rounding, just below a power of two, gives the same number as the right one."""
    x = F.abs(value.cast("double"))
    e = F.floor(F.log2(x))
    place = F.when(x == 0, 0).when(x >= 1.7e308, F.lit(2_200 * RANGES)).otherwise((e + 1_100) * RANGES + F.floor((x / F.pow(F.lit(2.0), e) - 1) * RANGES))
    return F.when(F.isnan(value.cast("double")), F.lit(2_300 * RANGES)).when(value < 0, -place).otherwise(place).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of several columns by key: keys, ``column``, ``n`` values, ``n_distinct``, and one double for each of ``shares`` (name: share, between
    neighbours on the line, as ``percentile``). Groups without a value have no row; a NULL key is a key; NaN is no value.

    No task holds a column's distinct values: values are counted once, counts summed by range of values (``value_range``), which tells the ranges that the
    wanted ranks are in, and only the values of these are put in order, one range a task. Few groups of many values are so the work of many tasks.
    """
    group = F.struct(*keys, "_column") if keys else F.struct("_column")
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(*keys, F.inline(cells)).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = long.select(group.alias("_group"), (F.col("_v") + 0.0).alias("_v")).groupBy("_group", "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_range", value_range(F.col("_v")))
    by_range = counts.groupBy("_group", "_range").agg(F.sum("_n").alias("_in"), F.count("*").alias("_distinct"))
    g = Window.partitionBy("_group")
    by_range = by_range.select(
        "_group", "_range", "_in", F.coalesce(F.sum("_in").over(g.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_in").over(g).alias("_all"), F.sum("_distinct").over(g).alias("_distinct")
    )
    place = lambda q: (F.col("_all") - 1) * F.lit(float(q))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(upper).alias("upper"), f(place(q)).cast("long").alias("rank")) for name, q in shares.items() for upper, f in ((False, F.floor), (True, F.ceil))])
    wanted = F.filter(ranks, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_in")))
    some = by_range.withColumn("_wanted", wanted).where(F.size("_wanted") > 0)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_group", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = counts.join(some, ["_group", "_range"]).withColumn("_upto", upto)
    hit = inside.select("_group", "_all", "_distinct", "_v", F.inline(F.filter("_wanted", lambda x: (x["rank"] < F.col("_upto")) & (x["rank"] >= F.col("_upto") - F.col("_n")))))
    value = lambda name, upper: F.max(F.when((F.col("name") == name) & (F.col("upper") == upper), F.col("_v")))

    def between(name: str, q: float) -> Column:
        low, high, part = value(name, False), value(name, True), F.max(place(q)) - F.floor(F.max(place(q)))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name)

    out = hit.groupBy("_group").agg(F.max("_all").alias("n"), F.max("_distinct").alias("n_distinct"), *[between(n, q) for n, q in shares.items()])
    return out.select(*[F.col(f"_group.`{k}`").alias(k) for k in keys], F.col("_group._column").alias("column"), "n", "n_distinct", *shares)


def hierarchical_cdf(
    df: DataFrame, levels: Sequence[Sequence[str]], value: str, train: Column, least: int = 0, out: str = "u", other: Column | None = None, other_levels: Sequence[Sequence[str]] = ()
) -> DataFrame:
    """Share of the training values that are not above a row's value, in the first level of buckets with ``least`` training values or
    more; the last level needs none. NULL without a value or without training values; a NULL in a column is a bucket of its own.
    Rows where ``other`` holds have buckets of their own, of ``other_levels``, so that two calibrations are one pass.

    Values are counted once, by all columns and value; the counts go to their bucket on every level, are cumulated within ranges of values
    (``value_range``: ``RANGES`` for each binade, so that a bucket of many values is the work of many tasks; repeated values are counted before) and
    over the ranges of a bucket; of each column tuple and value the first good level is kept and looked up by one join for all levels. Rows without
    a value are spread over the join's tasks.
    """
    columns = list(dict.fromkeys(c for level in (*levels, *other_levels) for c in level))
    kind = F.coalesce(other, F.lit(False)) if other is not None else F.lit(False)
    key = F.struct(kind.alias("_other"), *columns)
    rows = df.withColumns({"_key": key, "_v": F.col(value)})
    counts = rows.where("_v IS NOT NULL").groupBy("_key", "_v").agg(F.sum(F.when(train, 1).otherwise(0)).alias("_n"))
    part = lambda c, level: F.when(F.lit(c in level), F.col(f"_key.`{c}`")).alias(c)
    buckets = lambda lists, first: F.array(*[F.struct(F.lit(first + k).alias("level"), F.lit(k == len(lists) - 1).alias("last"), *[part(c, level) for c in columns]) for k, level in enumerate(lists)])
    every = F.when(F.col("_key._other"), buckets(other_levels, len(levels))).otherwise(buckets(levels, 0)) if other_levels else buckets(levels, 0)
    spread = counts.select("_key", "_v", "_n", F.coalesce(value_range(F.col("_v")), F.lit(0)).alias("_range"), F.explode(every).alias("_bucket"))
    by_range = spread.groupBy("_bucket", "_range").agg(F.sum("_n").alias("_n"))
    bucket = Window.partitionBy("_bucket")
    before = F.coalesce(F.sum("_n").over(bucket.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_range = by_range.select("_bucket", "_range", before.alias("_before"), F.sum("_n").over(bucket).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_bucket", "_range").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = spread.withColumn("_upto", upto).join(by_range, ["_bucket", "_range"])
    share = divide((F.col("_before") + F.col("_upto")).cast("double"), F.col("_all"))
    good = (F.col("_all") >= least) | F.col("_bucket.last")
    picks = [F.max(F.when((F.col("_bucket.level") == k) & good, share)).alias(f"_s{k}") for k in range(len(levels) + len(other_levels))]
    table = ranked.groupBy("_key", "_v").agg(*picks).select("_key", "_v", F.coalesce(*[f"_s{k}" for k in range(len(picks))]).alias(out), F.lit(0).alias("_salt"))
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    salt = F.when(F.col("_v").isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.drop(out).withColumn("_salt", salt).join(table, ["_key", "_v", "_salt"], "left").drop("_key", "_v", "_salt")


def empirical_cdf(df: DataFrame, keys: Sequence[str], value: str, train: Column, out: str = "u") -> DataFrame:
    """Share of the key's training values that are not above a value; NULL where the key has none."""
    return hierarchical_cdf(df, [list(keys)], value, train, out=out)


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 220, fine: int = 20, cover: tuple[float, float] = (0.005, 0.995), least: int = 5) -> DataFrame:
    """Gaussian kernel density at ``points`` places between two quantiles of each key's finite values: keys, point, x, density.

    The bandwidth is 1.06 deviations times the number of values to the power -1/5. Values are counted in bins of a ``fine``th of it, each standing at
    its mean, and the kernel goes over the bins: so many rows a key as the bins that the places see (the spread over the bandwidth), whatever the number of
    values. Keys with fewer than ``least`` values or without spread have no rows.
    """
    x = F.col(value).cast("double")
    known = df.where(F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)).select(*keys, x.alias("_v"))
    s = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_s"), F.percentile("_v", list(cover)).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    s = s.where((F.col("_n") >= least) & (F.col("_s") > 0)).withColumn("_bw", 1.06 * F.col("_s") * F.pow("_n", F.lit(-0.2)))
    ends = F.get("_q", F.lit(0)) < F.get("_q", F.lit(1))
    s = s.withColumns({"_lo": F.when(ends, F.get("_q", F.lit(0))).otherwise(F.col("_min")), "_hi": F.when(ends, F.get("_q", F.lit(1))).otherwise(F.col("_max"))}).drop("_q", "_min", "_max")
    near = F.col("_v").between(F.col("_lo") - 6 * F.col("_bw"), F.col("_hi") + 6 * F.col("_bw"))
    at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_bw") / fine))
    bins = known.join(s, list(keys)).where(near).groupBy(*keys, at.alias("_bin")).agg(F.count("*").alias("_c"), F.avg("_v").alias("_m"))
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1))
    z = (F.col("x") - F.col("_m")) / F.col("_bw")
    sums = grid.join(bins, list(keys)).groupBy(*keys, "point", "x", "_n", "_bw").agg(F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_d"))
    return sums.select(*keys, "point", "x", (F.col("_d") / (F.col("_n") * F.col("_bw") * (2 * pi) ** 0.5)).alias("density"))
