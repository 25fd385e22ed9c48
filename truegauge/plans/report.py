"""Report tables in their published layouts: metrics by surface, models by surface and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.operators.shaping import melt, transpose


def metrics_by_surface(metrics: DataFrame, surface: str, names: Sequence[str]) -> DataFrame:
    """One row per metric, one column per surface."""
    values = [c for c in metrics.columns if c != surface]
    numeric = metrics.select(surface, *[F.col(c).cast("double").alias(c) for c in values])
    return transpose(numeric, surface, names).withColumnRenamed("field", "metric")


def models_wide(comparison: DataFrame, surface: str, model: str, metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per model, one ``<surface>_<metric>`` column per combination."""
    long = melt(comparison.select(surface, model, *metrics), [surface, model], list(metrics))
    long = long.withColumn("_cell", F.concat_ws("_", surface, "metric"))
    cells = [f"{s}_{m}" for s in names for m in metrics]
    return long.groupBy(model).pivot("_cell", cells).agg(F.avg("value"))


def surface_reports(
    overall: DataFrame, comparison: DataFrame, bidirectional: DataFrame, diagnosis: DataFrame, surface: str, model: str, names: Sequence[str]
) -> dict[str, DataFrame]:
    """The wide sheets of a training run, ready for the table sink."""
    return {
        "overall": metrics_by_surface(overall, surface, names),
        "models": models_wide(comparison, surface, model, ["r2", "rmse", "mae"], names),
        "directions": models_wide(bidirectional, surface, model, ["mae_low", "mae_high"], names),
        "diagnosis": metrics_by_surface(diagnosis, surface, names),
    }
