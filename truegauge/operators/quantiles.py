"""Exact order statistics and average-tie ranks on pre-aggregated distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.operators.ordered import GROUP, PART, group_key, lay_out, running_totals
from truegauge.session import materialise


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: dict[str, Column] | None = None, partitions: int | None = None
) -> DataFrame:
    """Distinct values with ``cnt``, running ``upto`` (inclusive), ``upto_all``, and the same for each weight.

    Duplicates collapse before anything is sorted, so a value held by a third of all rows is one row.
    """
    extra = weight or {}
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(e).alias(f"w_{n}") for n, e in extra.items()])
    )
    sums = {"upto": F.col("cnt"), **{f"cum_{n}": F.col(f"w_{n}") for n in extra}}
    return running_totals(counts, by, [value], sums, partitions, overall=True)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    mean: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per entry of ``probs``; optionally the mean too.

    The result, one row per group, is written: its readers do not repeat the ordering, and the
    planner sees its true size when it decides whether to broadcast it.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    laid = lay_out(counts, by, [value], partitions).withColumn(GROUP, group_key(by))

    # One summary row per (group, partition) tells which partition holds each wanted rank.
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        laid.groupBy(PART, GROUP)
        .agg(F.sum("_cnt").alias("_c"), F.sum(F.col(value).cast("double") * F.col("_cnt")).alias("_s"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_c").over(earlier), F.lit(0)),
                "_n": F.sum("_c").over(Window.partitionBy(GROUP)),
                "_sum": F.sum("_s").over(Window.partitionBy(GROUP)),
            }
        )
    )
    wanted = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            wanted.append(F.struct(F.lit(f"_{side}{i}").alias("slot"), (k - F.col("_before")).alias("k")))
    here = F.filter(F.array(*wanted), lambda w: (w["k"] >= 0) & (w["k"] < F.col("_c")))
    targets = parts.select(PART, GROUP, "_n", "_sum", here.alias("_wanted")).where(F.size("_wanted") > 0)

    # Only those partitions are ordered; the rest of the data is not moved again.
    inner = Window.partitionBy(PART, GROUP).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.join(targets, [PART, GROUP]).withColumn("_upto", F.sum("_cnt").over(inner))
    start = F.col("_upto") - F.col("_cnt")
    hits = F.filter("_wanted", lambda w: (w["k"] >= start) & (w["k"] < F.col("_upto")))
    found = local.select(*by, value, "_n", "_sum", F.explode(hits["slot"]).alias("_slot"))
    picked = found.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.max("_sum").alias("_sum"),
        *[
            F.max(F.when(F.col("_slot") == f"_{side}{i}", F.col(value).cast("double"))).alias(f"_{side}{i}")
            for i in range(len(probs))
            for side in ("lo", "hi")
        ],
    )
    frac = {i: (F.col("_n") - 1) * F.lit(float(p)) for i, p in enumerate(probs.values())}
    out = picked.select(
        *by,
        *([(F.col("_sum") / F.col("_n")).alias(mean)] if mean else []),
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (frac[i] - F.floor(frac[i]))).alias(name)
            for i, name in enumerate(probs)
        ],
    )
    return materialise(out, "quantiles")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """One row per distinct value with its 1-based average-tie ``rank`` and its ``cnt``."""
    at = value_positions(df.select(*by, value), value, by, partitions=partitions)
    return at.select(*by, value, "cnt", (F.col("upto") - (F.col("cnt") - 1) / 2).alias("rank"))
