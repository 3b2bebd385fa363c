"""What a review of a feature table or of saved predictions needs: metrics, retraining state, quality of inputs, densities, event windows, markers, catalogues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chronoloom.functions.frames import Keys, ordered
from chronoloom.functions.scalar import finite, log_guarded, micros, pinball
from chronoloom.operators.aggregates import exact_quantiles
from chronoloom.operators.pressure import score_model
from chronoloom.operators.recursive import cooldown_events
from chronoloom.operators.selection import evenly_thinned

# Coverage error and gain over the null model (percent) beyond which a model is retrained or watched.
ERROR_RETRAIN, ERROR_WATCH = 0.08, 0.05
GAIN_RETRAIN, GAIN_WATCH = -1.0, 0.5

# Parts of a column's name, the range that its values should keep, the range's text. The first that fits counts.
EXPECTED = (
    (("conflict", "persistence", "freshness", "quality", "rejection_score", "cascade_score", "active_dominance_score", "liq_neutrality_score"), 0.0, 1.0, "[0, 1]"),
    (("active_force",), -1.0, 1.0, "[-1, 1]"),
    (("score", "strength"), 0.0, 100.0, "[0, 100]"),
    (("count", "age_hours"), 0.0, float("inf"), ">=0"),
)
KERNEL = (1, 2, 3, 4, 3, 2, 1)


def prediction_metrics(df: DataFrame, by: Sequence[str], actual: str, predicted: str, q: float) -> DataFrame:
    """Pinball loss, absolute error, centres and the share of positive outcomes, over the rows that have both values."""
    y, p = F.col(actual), F.col(predicted)
    both = df.where(y.isNotNull() & p.isNotNull())
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(pinball(y, p, q)).alias("pinball"), F.avg(F.abs(y - p)).alias("mae"), F.avg(y).alias("mean_actual"), F.percentile(actual, 0.5).alias("median_actual"),
        F.avg(p).alias("mean_predicted"), F.avg((y > 0).cast("double")).alias("hit_rate"),
    )


def _worst(where: Column, error: str, gain: str) -> Column:
    return F.struct(F.count_if(where).alias("n"), F.max(F.when(where, F.abs(error))).alias("error"), F.min(F.when(where, F.col(gain))).alias("gain"))


def retrain_status(calibration: DataFrame, recent: DataFrame | None = None, split: str = "split", error: str = "coverage_error", gain: str = "improvement") -> DataFrame:
    """One row: the largest coverage error and smallest gain of the test rows (else the validation's, else all), those of the recent rows, and ok, watch or retrain_now."""
    parts = [F.col(split) == "test", F.col(split) == "validation", F.lit(True)]
    one = calibration.agg(*[_worst(w, error, gain).alias(f"_{i}") for i, w in enumerate(parts)])
    chosen = F.when(F.col("_0.n") > 0, F.col("_0")).when(F.col("_1.n") > 0, F.col("_1")).otherwise(F.col("_2"))
    one = one.select(chosen.error.alias("worst_error"), chosen.gain.alias("least_gain"))
    if recent is None:
        one = one.withColumns({"recent_error": F.lit(None).cast("double"), "recent_gain": F.lit(None).cast("double")})
    else:
        one = one.crossJoin(recent.agg(F.max(F.abs(error)).alias("recent_error"), F.min(gain).alias("recent_gain")))  # one row each
    e, g = F.greatest("worst_error", "recent_error"), F.least("least_gain", "recent_gain")
    state = F.when((e > ERROR_RETRAIN) | (g < GAIN_RETRAIN), "retrain_now").when((e > ERROR_WATCH) | (g < GAIN_WATCH), "watch").otherwise("ok")
    return one.withColumn("status", state)


def expected_range(name: str) -> tuple[float, float, str] | None:
    return next(((low, high, text) for parts, low, high, text in EXPECTED if any(p in name for p in parts)), None)


def input_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per asked column whether it exists, its share of missing values and of values outside of the range its name implies; one pass."""
    kinds, sums, each = {f.name: f.dataType for f in df.schema.fields}, [], []
    for i, c in enumerate(columns):
        known, out, text = F.lit(False), F.lit(None).cast("double"), "missing"
        if c in kinds:
            number, wanted = isinstance(kinds[c], NumericType), expected_range(c)
            x = F.col(c).cast("double") if number else F.col(c)
            known = x.isNotNull() & ~F.isnan(x) if number else x.isNotNull()
            text = "categorical" if not number else "finite" if wanted is None else wanted[2]
            if number:
                bad = F.abs(x) == float("inf") if wanted is None else (x < wanted[0]) | (x > wanted[1])
                out = F.avg(F.when(known, bad.cast("double")).otherwise(None if wanted is None else 0.0))
        sums += [F.avg((~known).cast("double")).alias(f"m{i}"), out.alias(f"o{i}")]
        each.append(F.struct(F.lit(c).alias("column"), F.lit(c in kinds).alias("exists"), F.col(f"m{i}").alias("missing_rate"), F.col(f"o{i}").alias("outlier_rate"), F.lit(text).alias("expected_range")))
    return df.agg(*sums).select(F.inline(F.array(*each)))


def input_statistics(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Per numeric column: share missing, share beyond three interquartile ranges of the quartiles, moments, quartiles and ends. Quartiles are
    exact (``exact_quantiles``: no task holds a column's distinct values), or approximate in one pass with an ``accuracy``."""
    df = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    share, n = [0.25, 0.5, 0.75], range(len(columns))
    if accuracy is None:
        exact = exact_quantiles(df, [], columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
        q = exact.agg(*[F.max(F.when(F.col("column") == c, F.array("p25", "p50", "p75"))).alias(f"_q{i}") for i, c in enumerate(columns)])
    else:
        q = df.agg(*[F.percentile_approx(c, share, accuracy).alias(f"_q{i}") for i, c in enumerate(columns)])
    with_q, sums = df.crossJoin(F.broadcast(q)), []  # one row
    for i, c in enumerate(columns):
        q1, q3 = F.get(f"_q{i}", F.lit(0)), F.get(f"_q{i}", F.lit(2))
        far = F.coalesce((F.col(c) < q1 - 3 * (q3 - q1)) | (F.col(c) > q3 + 3 * (q3 - q1)), F.lit(False))
        sums += [
            F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}"), F.avg(F.when(q3 > q1, far.cast("double"))).alias(f"o{i}"), F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
            F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.first(f"_q{i}").alias(f"q{i}"),
        ]
    names = {"m": "missing_rate", "o": "outlier_rate", "a": "mean", "s": "std", "l": "v_min", "h": "v_max"}
    each = [F.struct(F.lit(columns[i]).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in names.items()], *[F.get(f"q{i}", F.lit(j)).alias(p) for j, p in enumerate(("p25", "p50", "p75"))]) for i in n]
    return with_q.agg(*sums).select(F.inline(F.array(*each)))


def null_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of NULLs by column, in one pass."""
    one = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_percent")) for i, c in enumerate(columns)])))


def smoothed_density(df: DataFrame, value: str, bins: int = 140, least: int = 10) -> DataFrame:
    """Density of equal-width bins between the ends and its average under a triangular kernel of seven bins (zeros beyond the ends);
    no rows with fewer than ``least`` values or a single distinct one."""
    x = df.select(finite(F.col(value).cast("double")).alias("_x")).where("_x IS NOT NULL")
    ends = x.agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("_all")).where((F.col("_high") > F.col("_low")) & (F.col("_all") >= least))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("_n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends)).join(F.broadcast(counts), "bin", "left")  # as many rows as bins
    grid = grid.withColumn("density", F.coalesce("_n", F.lit(0)) / (F.col("_all") * width))
    w, mid = Window.partitionBy("_all").orderBy("bin"), len(KERNEL) // 2
    smooth = sum((k / sum(KERNEL) * F.lag("density", i - mid, 0.0).over(w) for i, k in enumerate(KERNEL)), F.lit(0.0))
    return grid.select("bin", (F.col("_low") + (F.col("bin") + 0.5) * width).alias("centre"), "density", smooth.alias("smooth"))


def return_event_study(df: DataFrame, keys: Sequence[str], ts: str, price: str, event: str, before: int, after: int) -> DataFrame:
    """Median over events of the log return since ``before`` rows ahead of the event, by distance in rows. Only events whose whole window
    is in the series count; an unknown return counts as none."""
    w = ordered(keys, ts)
    log = log_guarded(price)
    rows = df.withColumn("_step", F.coalesce(log - F.lag(log).over(w), F.lit(0.0)))
    rows = rows.withColumns({"_way": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_start": F.lag(F.lit(1), before).over(w), "_end": F.lead(F.lit(1), after).over(w), "_rn": F.row_number().over(w)})
    whole = rows.where(F.col(event) & F.col("_start").isNotNull() & F.col("_end").isNotNull())
    asked = whole.select(*keys, F.col("_rn").alias("_event"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("_rn", F.col("_event") + F.col("offset"))
    way = asked.join(rows.select(*keys, "_rn", "_way"), [*keys, "_rn"])
    first = Window.partitionBy(*keys, "_event").orderBy("offset")
    return way.withColumn("_r", F.col("_way") - F.first("_way").over(first)).groupBy("offset").agg(F.percentile("_r", 0.5).alias("median"), F.count("*").alias("n"))


def event_windows(df: DataFrame, keys: Sequence[str], ts: str, price: str, sides: Sequence[str], quantile: float = 0.99, before: int = 12, after: int = 24, gap: int = 12) -> DataFrame:
    """For each side the event study of its largest values: at or above the key's quantile, each more than ``gap`` rows after the one before."""
    out = []
    for side in sides:
        known = df.where(F.col(side).isNotNull()).select(*keys, ts, side)
        level = known.groupBy(*keys).agg(F.percentile(side, quantile).alias("_level"))
        chosen = cooldown_events(known.join(level, list(keys)), keys, [ts], side, "_level", gap, "_event").where("_event").select(*keys, ts, "_event")
        marked = df.select(*keys, ts, price).join(chosen, [*keys, ts], "left").withColumn("_event", F.coalesce("_event", F.lit(False)))
        out.append(return_event_study(marked, keys, ts, price, "_event", before, after).withColumn("side", F.lit(side)))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


def axis_bounds(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bounds of a chart's axis: the 0.5 % and 99.5 % quantiles (the ends where these coincide) with a margin of 8 %; a constant has a margin
    of a tenth of itself; no value, -1 and 1."""
    q = df.withColumn("_x", finite(F.col(value).cast("double"))).groupBy(*keys).agg(F.percentile("_x", [0.005, 0.5, 0.995]).alias("_q"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    p, mid, r = (F.get("_q", F.lit(k)) for k in range(3))
    low, high = F.when(p < r, p).otherwise(F.col("_a")), F.when(p < r, r).otherwise(F.col("_b"))
    pad = F.when(high > low, 0.08 * (high - low)).otherwise(F.greatest(0.1 * F.abs(mid), F.lit(1e-6)))
    a, b = F.when(high > low, low).otherwise(mid) - pad, F.when(high > low, high).otherwise(mid) + pad
    return q.select(*keys, F.coalesce(a, F.lit(-1.0)).alias("axis_low"), F.coalesce(b, F.lit(1.0)).alias("axis_high"))


def outlier_markers(df: DataFrame, keys: Sequence[str], ts: str, value: str, beyond: float = 5.0, most: int = 500) -> DataFrame:
    """Of each key the rows more than ``beyond`` standard deviations from its mean, the farthest ``most`` of them (marks on a chart)."""
    x = finite(F.col(value).cast("double"))
    scale = df.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"), F.count(x).alias("_n")).where("_n >= 3 AND _std > 0")
    far = df.join(scale, list(keys)).withColumn("z", F.abs(x - F.col("_mean")) / F.col("_std")).where(F.col("z") > beyond)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z"), ts))
    return far.withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn", "_mean", "_std", "_n")


def missing_markers(df: DataFrame, keys: Keys, ts: str, value: str, most: int = 500) -> DataFrame:
    """Times without a value, thinned evenly to ``most`` a key."""
    return evenly_thinned(df.where(finite(F.col(value).cast("double")).isNull()), keys, ts, most).select(*keys, ts)


def paired_sample(df: DataFrame, keys: Keys, ts: str, x: str, y: str, most: int) -> DataFrame:
    """Rows with both values finite, thinned evenly to ``most`` a key."""
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in (x, y)}).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return evenly_thinned(clean, keys, ts, most).select(*keys, ts, x, y)


def incremental(source: DataFrame, cache: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str, reach: int) -> DataFrame:
    """The cache and the features of the rows later than its last time, built from these rows and the ``reach`` microseconds before them.

    The same as building everything, if no feature looks further back than ``reach``; an empty cache means all rows.
    """
    mark = cache.agg(F.max(micros(ts)).alias("_mark"))
    after = lambda df, back: df.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (micros(ts) > F.col("_mark") - back)).drop("_mark")
    return cache.unionByName(after(build(after(source, reach)), 0))


def latest_payload(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row by order as one JSON object, NULLs included; ``{}`` without rows."""
    last = df.agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return last.select(F.coalesce(F.to_json("_last", {"ignoreNullFields": "false"}), F.lit("{}")).alias("payload"))


def catalogue(spark: SparkSession, documented: Sequence[tuple[str, str, str]], columns: Sequence[str], categories: Mapping[str, str], others: str = "other") -> DataFrame:
    """Documented (name, category, description) and actual columns merged; undocumented ones take the category of the first name part found."""
    known = spark.createDataFrame(list(documented), "name string, category string, description string").withColumn("documented", F.lit(True))
    actual = spark.createDataFrame([(c,) for c in columns], "name string").withColumn("actual", F.lit(True))
    both = known.join(actual, "name", "full")
    guess = F.lit(others)
    for part, category in reversed(categories.items()):
        guess = F.when(F.col("name").contains(part), category).otherwise(guess)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select("name", F.coalesce("category", guess).alias("category"), F.coalesce("description", F.lit("not documented")).alias("description"), flag("documented"), flag("actual"))


def as_markdown(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A small table as the lines of a Markdown table: (line number, line)."""
    cells = [F.coalesce(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), r"\s+", " "), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("i"), line.alias("line"))  # a table for readers: few rows
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + " --- |" * len(df.columns))], "i int, line string")
    return head.unionByName(body)


def scored(df: DataFrame, coefficients: Mapping[str, float], intercept: float, reliability: str, direction: str) -> DataFrame:
    """Batch inference with a saved linear model: size, and the expectation signed by direction and weighted by reliability."""
    size, expectation = score_model(dict(coefficients), intercept, F.col(reliability), F.col(direction))
    return df.withColumns({"size": size, "expectation": expectation})
