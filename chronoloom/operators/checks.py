"""Data-quality and leakage checks: rules become one aggregate, the result one row per check with PASS, WARN or FAIL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import finite


@dataclass(frozen=True)
class Check:
    """A condition that rows must meet; more than ``fail_share`` of bad rows fails, any at all warns (or fails at 0).

    Below the share a ``quiet`` check passes."""

    name: str
    holds: Column
    fail_share: float = 0.0
    quiet: bool = False


def required_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One pass over the rows; (check, n_bad, n_rows, status)."""
    sums = [F.coalesce(F.sum(F.when(F.coalesce(c.holds, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(f"c{k}") for k, c in enumerate(checks)]
    one = df.agg(F.count("*").alias("n_rows"), *sums)
    each = F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(f"c{k}").cast("long").alias("n_bad"), F.lit(float(c.fail_share)).alias("fail_share"), F.lit(c.quiet).alias("quiet")) for k, c in enumerate(checks)])
    rows = one.select("n_rows", F.inline(each))
    bad = F.col("n_bad") > F.col("fail_share") * F.col("n_rows")
    return rows.select("check", "n_bad", "n_rows", F.when(F.col("n_bad") == 0, "PASS").when(bad, "FAIL").when(F.col("quiet"), "PASS").otherwise("WARN").alias("status"))


def ohlc_checks(prefix: str = "") -> list[Check]:
    o, h, l, c = (F.col(prefix + n) for n in ("open", "high", "low", "close"))
    return [
        Check("high_not_below", (h >= F.greatest(o, c)) & (h >= l)),
        Check("low_not_above", l <= F.least(o, c)),
        Check("prices_positive", (o > 0) & (h > 0) & (l > 0) & (c > 0)),
    ]


def between(name: str, low: float, high: float) -> Check:
    return Check(f"{name}_in_range", F.col(name).isNull() | F.col(name).between(low, high))


def positive(name: str) -> Check:
    return Check(f"{name}_positive", F.col(name).isNull() | (F.col(name) > 0))


def not_negative(name: str) -> Check:
    return Check(f"{name}_not_negative", F.col(name).isNull() | (F.col(name) >= 0))


def one_of(name: str, values: Sequence[object]) -> Check:
    return Check(f"{name}_allowed", F.col(name).isNull() | F.col(name).isin(*values))


def whole_between(name: str, low: int, high: int) -> Check:
    x = F.col(name)
    return Check(f"{name}_whole_in_range", x.isNull() | (x.between(low, high) & (x == F.floor(x))))


def identity(name: str, left: Column, right: Column, tolerance: float = 1e-6) -> Check:
    """Both sides agree where both are known."""
    return Check(name, left.isNull() | right.isNull() | (F.abs(left - right) <= tolerance))


def finite_only(name: str) -> Check:
    x = F.col(name).cast("double")
    return Check(f"{name}_finite", x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf"))))


def mostly_known(name: str, most: float) -> Check:
    """At most this share of the rows has no value, or none that is a finite number."""
    x = F.col(name).cast("double")
    return Check(f"{name}_known", x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), most, True)


@dataclass(frozen=True)
class Family:
    """Names of the columns of a two-sided frame."""

    long_side: str = "long_level"
    short_side: str = "short_level"
    total: str = "total_level"
    difference: str = "diff_level"
    share: str = "share"
    dominance: str = "dominance_share"
    price: str = "price"


def family_checks(f: Family = Family(), active: str | None = None) -> list[Check]:
    """Ranges and identities of a two-sided frame: what the sides, their sum, difference and shares must have in common."""
    l, s, total = F.col(f.long_side), F.col(f.short_side), F.col(f.total)
    flag = [identity("active_matches_total", F.col(active).cast("double"), (total > 1e-6).cast("double"))] if active else []
    return [
        positive(f.price), *[not_negative(c) for c in (f.long_side, f.short_side, f.total)], between(f.share, 0.0, 1.0), between(f.dominance, -1.0, 1.0),
        identity("total_is_sum", total, l + s), identity("difference_is_difference", F.col(f.difference), l - s),
        identity("dominance_follows_share", F.col(f.dominance), 2 * F.col(f.share) - 1), *flag, *[finite_only(c) for c in (f.long_side, f.short_side, f.total, f.difference)],
    ]


def stage_checks(stage: str, columns: Sequence[str], f: Family = Family(), *, active: str | None = None, bins: str = "bin_index", most_unknown: float = 0.5) -> list[Check]:
    """The checks of a stage of the feature chain: ``clean``, ``canonical``, ``dominance``, ``contract``, ``model`` or ``final``.

    Columns that a stage needs must be there, or it is an error; the further ones are checked where they are."""
    present = set(columns)
    base = [f.price, f.share] if stage == "model" else [f.long_side, f.short_side, f.total, f.difference, f.share, f.dominance, f.price]
    needed = base + ([bins] if stage not in ("clean", "canonical") else []) + ([active] if active and stage in ("clean", "canonical", "dominance") else [])
    if missing := sorted(set(needed) - present):
        raise ValueError(f"stage {stage}: missing columns: {', '.join(missing)}")
    checks = [positive(f.price), between(f.share, 0.0, 1.0)] if stage == "model" else family_checks(f, active if stage in ("clean", "canonical", "dominance") else None)
    if bins in needed:
        checks.append(whole_between(bins, 0, 8))
        checks += [one_of(c, (-1, 0, 1)) for c in ("dominance", "dominance_last", "dominance_prev", "hit", "reverse_hit", "extreme") if c in present]
        checks += [one_of(c, (0, 1)) for c in ("keep", "strengthen") if c in present]
    if stage in ("model", "final"):
        checks += [mostly_known(c, most_unknown) for c in columns if c.startswith("z_")]
    return checks


def time_checks(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows without a time, and rows that share theirs with another, as rows of a report."""
    once = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"))
    one = once.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("n_rows", F.col("_n")), ("unknown", F.when(F.col(ts).isNull(), F.col("_n")).otherwise(0)), ("twice", F.when(F.col(ts).isNotNull(), F.col("_n") - 1).otherwise(0)))])
    each = F.array(*[F.struct(F.lit(f"{ts}_{n}").alias("check"), F.col(c).alias("n_bad")) for n, c in (("known", "unknown"), ("unique", "twice"))])
    return one.select("n_rows", F.inline(each)).select("check", "n_bad", "n_rows", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder of any store that Spark reads, of all that match where the path has wildcards; 0 where nothing does. Paths named as markers don't count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [m.getPath() for m in store.globStatus(at) or []]
    return sum(store.getContentSummary(p).getLength() for p in found if not p.getName().startswith(("_", ".")))


def artifact_checks(spark: SparkSession, paths: Mapping[str, str], counted: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """One row for each named path: PASS where it is there and not empty; and for each pattern of ``counted`` whether as many paths match as are
    expected. Only names and sizes are read, of the paths that the caller states."""
    rows = [(f"{n}_exists", 0 if stored_bytes(spark, p) else 1, 1) for n, p in paths.items()]
    for name, (pattern, least) in (counted or {}).items():
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        n = len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])
        rows.append((f"{name}_count", max(0, least - n), least))
    return spark.createDataFrame([(n, bad, of, "FAIL" if bad else "PASS") for n, bad, of in rows], "check string, n_bad long, n_rows long, status string")


def cache_report(spark: SparkSession, path: str, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Checks of a stored Parquet or CSV table: it is there; its times are known and unique by key, its numbers finite and not negative. A table that is
    missing or empty has its first row alone."""
    there = artifact_checks(spark, {"table": path})
    if not stored_bytes(spark, path):
        return there
    csv = path.rstrip("/").endswith((".csv", ".csv.gz"))
    df = spark.read.options(header=True).csv(path) if csv else spark.read.parquet(path)
    if csv:
        df = df.withColumns({ts: F.col(ts).try_cast("timestamp_ntz"), **{v: F.col(v).try_cast("double") for v in values}})
    required_columns(df, [*keys, ts, *values])
    return there.unionByName(time_checks(df, keys, ts)).unionByName(run_checks(df, [c for v in values for c in (not_negative(v), finite_only(v))]))


def require_pass(report: DataFrame) -> None:
    """Raises with the names of the failed checks. A report has one row for each check."""
    failed = [f"{r.check} ({r.n_bad} of {r.n_rows})" for r in report.where(F.col("status") == "FAIL").orderBy("check").collect()]
    if failed:
        raise ValueError("failed checks: " + "; ".join(failed))


def leakage_report(df: DataFrame, source_ts: str, ts: str, age: str) -> DataFrame:
    """Sources later than their rows, negative ages, and columns whose names look ahead (REVIEW); checks without their column are SKIP."""
    has = set(df.columns)
    checks = [c for c, need in ((not_from_future(source_ts, ts), {source_ts, ts}), (not_negative(age), {age})) if need <= has]
    skipped = [n for n, need in ((f"{source_ts}_not_after_{ts}", {source_ts, ts}), (f"{age}_not_negative", {age})) if not need <= has]
    ahead = len(label_columns(df.columns))
    rows = [(n, 0, "SKIP") for n in skipped] + [("names_that_look_ahead", ahead, "REVIEW" if ahead else "PASS")]
    fixed = df.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(b).cast("long").alias("n_bad"), F.lit(s).alias("status")) for n, b, s in rows])))
    fixed = fixed.select("check", "n_bad", "n_rows", "status")
    return run_checks(df, checks).unionByName(fixed) if checks else fixed


def output_sanity(df: DataFrame, measures: Sequence[str], direction: str, reliability: str, state: str, up: int, down: int, most_unknown: float = 0.05, agree: float = 0.9) -> DataFrame:
    """Whether model outputs are finite, in range, and point the way their states say; one pass."""
    s, d = F.col(state), F.col(direction)
    along = lambda k, ok: Check(f"state_{k}_direction", ~F.coalesce(s == k, F.lit(False)) | d.isNull() | ok)
    rows = run_checks(df, [one_of(direction, (-1, 0, 1)), between(reliability, -1e-9, 1 + 1e-9), *[mostly_known(c, most_unknown) for c in measures], along(up, d >= 0), along(down, d <= 0)])
    of = df.agg(*[F.coalesce(F.sum(((s == k) & d.isNotNull()).cast("long")), F.lit(0)).alias(f"_of_{k}") for k in (up, down)])
    wide = rows.crossJoin(F.broadcast(of))
    for k in (up, down):
        mine, n = F.col("check") == f"state_{k}_direction", F.col(f"_of_{k}")
        wide = wide.withColumn("status", F.when(mine, F.when(F.col("n_bad") <= (1 - agree) * n, "PASS").otherwise("FAIL")).otherwise(F.col("status"))).withColumn("n_rows", F.when(mine, n).otherwise(F.col("n_rows")))
    return wide.select("check", "n_bad", "n_rows", "status")


def not_from_future(source_ts: str, ts: str) -> Check:
    return Check(f"{source_ts}_not_after_{ts}", F.col(source_ts).isNull() | (F.col(source_ts) <= F.col(ts)))


def simplex(names: Sequence[str], atol: float = 1e-6) -> Check:
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return Check("probabilities_sum_to_one", (F.abs(total - 1) <= atol) & (F.least(*[F.col(n) for n in names]) >= -atol))


#: Parts of column names that mark labels.
LABEL_PARTS = ("future_", "target_", "label_", "ret_", "exit_")


def label_columns(columns: Sequence[str], parts: Sequence[str] = LABEL_PARTS) -> list[str]:
    """Columns that look ahead by their names and must not reach a model's inputs."""
    return [c for c in columns if any(c.startswith(p) or f"_{p}" in c for p in parts)]


def time_profile(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows, duplicate times, median and largest step (seconds), and steps above 1.5 medians, by key."""
    once = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"))
    step = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)).cast("timestamp"))) / 1e6
    once = once.withColumn("_step", step)
    mid = once.groupBy(*keys).agg(F.percentile("_step", 0.5).alias("median_step"))
    return once.join(mid, list(keys)).groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"), F.first("median_step").alias("median_step"), F.max("_step").alias("max_step"),
        F.sum(F.when(F.col("_step") > 1.5 * F.col("median_step"), 1).otherwise(0)).alias("n_gaps"),
    )


def outlier_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shares beyond 3 IQR and 6 deviations, and the verdict by them."""
    w = df.groupBy(*keys).agg(F.percentile(value, [0.25, 0.75]).alias("_q"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    x, q1, q3 = F.col(value), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    out = df.join(w, list(keys)).groupBy(*keys).agg(
        F.avg(((x < q1 - 3 * (q3 - q1)) | (x > q3 + 3 * (q3 - q1))).cast("double")).alias("iqr_share"), F.avg((F.abs(x - F.col("_m")) > 6 * F.col("_s")).cast("double")).alias("z_share")
    )
    return out.withColumn("verdict", F.when(F.col("iqr_share") > 0.05, "FAIL").when(F.col("iqr_share") > 0.01, "WARN").otherwise("PASS"))


@dataclass(frozen=True)
class OutlierLimits:
    """When a value stands out; the defaults are the published ones."""

    z: float = 4.0
    iqr: float = 3.0
    tails: tuple[float, float] = (0.01, 0.99)
    explosion: float = 1000.0  # median deviations above the median's size
    cliff: float = 20.0  # median deviations of the steps above their median


OUTLIER_REASONS = ("zscore", "iqr", "extreme_quantile", "explosion", "cliff")


def outlier_marks(df: DataFrame, keys: Sequence[str], ts: str, value: str, s: OutlierLimits = OutlierLimits()) -> DataFrame:
    """Rows with a finite value: keys, time, value, ``z`` (NULL without spread), ``score`` (its size; without spread the value over the usual size), the
    key's thresholds, and a flag for each of ``OUTLIER_REASONS``. A cliff is a step to the row above the usual steps."""
    x = F.col("_x")
    known = df.select(*keys, ts, finite(F.col(value).cast("double")).alias("_x"))
    known = known.withColumn("_step", F.abs(x - F.lag(x).over(Window.partitionBy(*keys).orderBy(ts))))
    q = [0.25, 0.5, 0.75, *s.tails]
    first = known.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"), F.percentile(x, q).alias("_q"), F.percentile("_step", 0.5).alias("_step_mid"), F.percentile(F.abs(x), 0.5).alias("_usual"))
    first = first.select("*", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("_q1", "_mid", "_q3", "extreme_low", "extreme_high"))]).drop("_q")
    rows = known.join(first, list(keys))
    second = rows.groupBy(*keys).agg(F.percentile(F.abs(x - F.col("_mid")), 0.5).alias("_mad"), F.percentile(F.abs(F.col("_step") - F.col("_step_mid")), 0.5).alias("_step_mad"))
    rows = rows.join(second, list(keys)).where(x.isNotNull())
    least = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    iqr = F.col("_q3") - F.col("_q1")
    rows = rows.withColumns({
        "z": F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd")), "iqr_low": F.col("_q1") - s.iqr * iqr, "iqr_high": F.col("_q3") + s.iqr * iqr,
        "explosion_threshold": F.abs("_mid") + s.explosion * least("_mad"), "cliff_threshold": F.when(F.col("_step_mid").isNotNull(), F.col("_step_mid") + s.cliff * least("_step_mad")),
    })
    marks = {
        "zscore": F.abs("z") > s.z, "iqr": (iqr > 0) & ((x < F.col("iqr_low")) | (x > F.col("iqr_high"))), "extreme_quantile": (x < F.col("extreme_low")) | (x > F.col("extreme_high")),
        "explosion": F.abs(x) > F.col("explosion_threshold"), "cliff": F.col("_step") > F.col("cliff_threshold"),
    }
    rows = rows.withColumn("score", F.coalesce(F.abs("z"), F.abs(x) / least("_usual")))
    thresholds = ("iqr_low", "iqr_high", "extreme_low", "extreme_high", "explosion_threshold", "cliff_threshold")
    return rows.select(*keys, ts, x.alias(value), "z", "score", *thresholds, *[F.coalesce(m, F.lit(False)).alias(n) for n, m in marks.items()])


def outlier_counts(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Thresholds and the number of rows for each reason, by key."""
    thresholds = ("iqr_low", "iqr_high", "extreme_low", "extreme_high", "explosion_threshold", "cliff_threshold")
    return marks.groupBy(*keys).agg(F.count("*").alias("n"), *[F.first(t).alias(t) for t in thresholds], *[F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in OUTLIER_REASONS])


def outlier_examples(marks: DataFrame, keys: Sequence[str], ts: str, value: str, most: int = 30) -> DataFrame:
    """The ``most`` worst rows of each key with their reasons, the worst first (equal scores by time)."""
    reasons = F.concat_ws(",", *[F.when(F.col(r), F.lit(r)) for r in OUTLIER_REASONS])
    rows = marks.withColumn("reason", reasons).where("reason <> ''")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ts))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(*keys, "place", ts, value, "z", "reason")
