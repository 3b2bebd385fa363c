"""Retraining of the regime model beside a running stream: warm start, versions, and a pointer that moves last.

A new model starts from the one that is served, is written as a version of its own, and becomes current by ``versions.publish``; whatever fails before
leaves the served model. A stream that reads ``served`` once a micro-batch takes the new one with its next batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chronoloom.operators import regime
from chronoloom.sources import sinks, versions
from chronoloom.streaming.online import retrain_due


def save(spark: SparkSession, path: str, version: int, model: regime.Gaussians) -> None:
    """The model as one version; it isn't current yet."""
    flat = {"start": model.start, "move": model.move, "means": model.means, "variances": model.variances, "shape": np.array(model.means.shape, float)}
    sinks.save_parameters(spark, {k: [float(x) for x in v.ravel()] for k, v in flat.items()}, f"{path}/models/{version}")


def served(spark: SparkSession, path: str) -> tuple[int, regime.Gaussians | None]:
    """The current version and its model."""
    version = versions.current(spark, path)
    if not version:
        return 0, None
    p = {k: np.array(v) for k, v in sinks.load_parameters(spark, f"{path}/models/{version}").items()}
    k, d = p["shape"].astype(int)
    return version, regime.Gaussians(p["start"], p["move"].reshape(k, k), p["means"].reshape(k, d), p["variances"].reshape(k, d))


@dataclass(frozen=True)
class Outcome:
    """``status``: trained, kept (an error; ``error`` says which) or not_due."""

    status: str
    version: int
    error: str | None = None


def retrain(spark: SparkSession, history: DataFrame, path: str, features: Sequence[str], order: Sequence[str], k: int, sides: tuple[str, str] | None = None, **options: float) -> Outcome:
    """Train on a history, from the served model if there is one, and publish; the served model stays where anything fails.

    With ``sides`` (long, short) the states are put in order by their medians (``regime.relabelled_by_medians``)."""
    version, old = served(spark, path)
    try:
        model = regime.train(history, features, k, spark, order, warm=old, **options)
        if not all(np.isfinite(v).all() for v in (model.start, model.move, model.means, model.variances)):
            raise ValueError("the trained model has numbers that are not finite")
        if sides:
            one = history.selectExpr("*", "'all' AS _key")
            model, _ = regime.relabelled_by_medians(model, regime.forward_filter(one, ["_key"], order, features, model), "state", *sides)
        save(spark, path, version + 1, model)
        versions.publish(spark, path, version + 1)
    except Exception as error:  # noqa: BLE001 - whatever it is, the served model goes on
        return Outcome("kept", version, f"{type(error).__name__}: {error}")
    return Outcome("trained", version + 1)


def retraining(path: str, history: Callable[[], DataFrame], ts: str, features: Sequence[str], order: Sequence[str], k: int, sides: tuple[str, str] | None = None, days: int = 7, least_rows: int = 144, **options: float) -> Callable[[DataFrame, int], Outcome]:
    """A function for ``foreachBatch``: looks at the stored history after each micro-batch and retrains where it is due.

    The time of the last training is the newest time of the history that it saw, kept with the version."""

    def each(batch: DataFrame, epoch: int) -> Outcome:
        spark = batch.sparkSession
        version, rows = versions.current(spark, path), history()
        trained = str(spark.read.parquet(f"{path}/trained/{version}").first()[0]) if version else None
        if not retrain_due(rows, ts, trained, days, least_rows):
            return Outcome("not_due", version)
        newest = rows.agg({ts: "max"})
        newest.write.mode("overwrite").parquet(f"{path}/trained/{version + 1}")
        return retrain(spark, rows, path, features, order, k, sides, **options)

    return each
