"""Quantile and equal-width bins, histograms, interpolation on a grid."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.ordered import forward_fill, with_ordinal
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles


def bin_index(x: Column, edges: Sequence[Column]) -> Column:
    """1-based right-closed bin: distinct edges below ``x``; the lowest edge belongs to the first bin."""
    below = [
        F.when((e < x) & (F.lit(True) if i == 0 else e != edges[i - 1]), 1).otherwise(0) for i, e in enumerate(edges)
    ]
    return F.when(x.isNotNull(), F.greatest(functools.reduce(lambda a, b: a + b, below), F.lit(1)))


def quantile_bins(
    df: DataFrame, value: str, q: int, by: Sequence[str] = (), out: str = "bin", labels: Sequence[str] | None = None
) -> DataFrame:
    """Equal-frequency bins; duplicate edges merge."""
    names = [f"_e{i}" for i in range(q + 1)]
    edges = exact_quantiles(df, value, {n: i / q for i, n in enumerate(names)}, by)
    idx = bin_index(F.col(value), [F.col(n) for n in names])
    if labels:
        idx = F.element_at(F.array(*[F.lit(x) for x in labels]), idx)
    return attach(df, edges, by).withColumn(out, idx).drop(*names)


def equal_width_bins(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Right-closed bins of equal width; the minimum belongs to the first one."""
    span = df.groupBy(*by).agg(F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"))
    step = F.ceil((F.col(value) - F.col("_min")) / ((F.col("_max") - F.col("_min")) / F.lit(float(bins))))
    idx = F.when(F.col("_max") > F.col("_min"), F.greatest(F.lit(1), F.least(F.lit(bins), step))).otherwise(F.lit(1))
    return attach(df, span, by).withColumn(out, F.when(F.col(value).isNotNull(), idx.cast("int"))).drop("_min", "_max")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Left-closed density histogram per group on the common range of the whole table; a single value gets half a unit on either side."""
    rows = df.where(F.col(value).isNotNull())
    span = rows.agg(F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"))
    flat = F.when(F.col("_min") == F.col("_max"), 0.5).otherwise(0.0)
    span = span.select((F.col("_min") - flat).alias("_min"), (F.col("_max") + flat).alias("_max"))
    width = (F.col("_max") - F.col("_min")) / F.lit(float(bins))
    placed = attach(rows, span).withColumns(
        {"bin": F.least(F.floor((F.col(value) - F.col("_min")) / width), F.lit(bins - 1)).cast("int"), "_w": width}
    )
    counts = placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.first("_min").alias("_min"), F.first("_w").alias("_w")
    )
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_n"))
    return attach(counts, totals, by).select(
        *by,
        "bin",
        (F.col("_min") + F.col("bin") * F.col("_w")).alias("left"),
        "count",
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def bin_summary(binned: DataFrame, value: str, feature: str | None = None, by: Sequence[str] = ("bin",)) -> DataFrame:
    """Count, mean, deviation, standard error and 95% band of ``value`` per bin, with the bin's centre."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value))
    aggs = [
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), sem.alias("sem"),
        (F.avg(value) - 1.96 * sem).alias("low"), (F.avg(value) + 1.96 * sem).alias("high"),
    ]
    if feature:
        aggs.append(F.avg(feature).alias("centre"))
    return binned.groupBy(*by).agg(*aggs)


def interpolate(df: DataFrame, x: str, grid: DataFrame, gx: str, gy: str, out: str) -> DataFrame:
    """Piecewise-linear lookup of ``x`` on a grid of any size; clamped outside.

    The distinct values and the grid points are merged in one order and each value inherits the segment that
    starts at or before it, so neither side is compared with all of the other; rows then take the result of their
    value, so a value that many rows share is looked up once. NULL rows stay NULL.
    """
    pts = with_ordinal(grid.where(F.col(gx).isNotNull()).select(F.col(gx).cast("double").alias("x0"), F.col(gy).cast("double").alias("y0")), ["x0"], name="_i")
    nxt = pts.select((F.col("_i") - 1).alias("_i"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    segs = pts.join(nxt, "_i", "left").select(
        F.col("x0").alias("_x"), F.lit(0).alias("_kind"), F.struct("x0", "y0", "x1", "y1").alias("_seg")
    )
    rows = df.select(F.col(x).cast("double").alias("_x")).where("_x is not null").distinct().withColumn("_kind", F.lit(1))
    merged = rows.unionByName(segs, allowMissingColumns=True)
    filled = forward_fill(merged, ["_x", "_kind"], ["_seg"]).where("_kind = 1")
    first = pts.agg(F.min_by("y0", "x0").alias("_first"))
    s = F.col("_seg")
    inner = s.y0 + (s.y1 - s.y0) * (F.col("_x") - s.x0) / (s.x1 - s.x0)
    value = F.when(s.isNull(), F.col("_first")).when(s.x1.isNull(), s.y0).otherwise(inner)
    found = attach(filled, first).select("_x", value.alias("_found"))
    joined = df.withColumn("_own", F.col(x).cast("double")).join(found, F.col("_own") == F.col("_x"), "left")
    return joined.select(*[c for c in df.columns if c != out], F.col("_found").alias(out))
