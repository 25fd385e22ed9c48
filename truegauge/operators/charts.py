"""Tables behind charts: Q-Q pairs, box statistics, scatter samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.tails import normal_quantile
from truegauge.operators.quality import holds
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles
from truegauge.operators.splits import numbered


def normal_quantile_pairs(df: DataFrame, value: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Ordered values against normal order-statistic medians: ``.5^(1/n)`` at the top end,
    ``(i - .3175) / (n + .365)`` inside."""
    placed = numbered(df.where(F.col(value).isNotNull()), [value, *tie], by)
    n, i = F.col("_n").cast("double"), F.col("_i").cast("double") + 1
    end = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    return placed.select(*by, *tie, F.col(value).alias("ordered_value"), normal_quantile(p).alias("theoretical"))


def box_statistics(df: DataFrame, value: str, category: str) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 IQR, and the number of points beyond."""
    q = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [category])
    x, iqr = F.col(value), F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return (
        attach(df.select(category, value), q, [category])
        .groupBy(category)
        .agg(
            *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
            F.min(F.when(x >= low, x)).alias("low"),
            F.max(F.when(x <= high, x)).alias("high"),
            F.count_if(holds((x < low) | (x > high))).alias("outliers"),
        )
    )


def scatter_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """A reproducible sample of fixed size for drawing: the rows with the smallest key hash."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(rows).drop("_h")
