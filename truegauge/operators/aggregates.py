"""Distribution profiles, sign balance and scoped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles


def adjusted_skew(x: str) -> Column:
    """Bias-adjusted skewness (NULL below 3 values)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: str) -> Column:
    """Bias-adjusted excess kurtosis (NULL below 4 values)."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sign_balance(df: DataFrame, delta: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of positive and negative values; zero is neither."""
    d, n = F.col(delta), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("total"),
        F.count_if(d > 0).alias("pos"),
        F.count_if(d < 0).alias("neg"),
        (F.count_if(d > 0) * 100.0 / n).alias("pos_pct"),
        (F.count_if(d < 0) * 100.0 / n).alias("neg_pct"),
        F.avg(d).alias("mean"),
    )


def profile(df: DataFrame, value: str, by: Sequence[str] = (), min_samples: int = 0) -> DataFrame:
    """Count, moments, extremes, exact quartiles and sign shares per group."""
    x, n = F.col(value), F.count(value)
    moments = df.groupBy(*by).agg(
        n.alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        adjusted_skew(value).alias("skew"),
        adjusted_kurtosis(value).alias("kurtosis"),
        F.try_divide(F.count_if(x > 0), n).alias("pos_ratio"),
        F.try_divide(F.count_if(x < 0), n).alias("neg_ratio"),
    )
    if min_samples:
        moments = moments.where(F.col("count") >= min_samples)
    return attach(moments, exact_quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by), by)


def largest_groups(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The k most frequent groups, name as tie-break (a report feature)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"))
    return sizes.orderBy(F.desc("samples"), *by).limit(k)


def profile_groups(df: DataFrame, value: str, group: str, max_groups: int, min_samples: int = 30, only: Sequence[str] | None = None) -> DataFrame:
    """Profile of a whitelist of groups, or of the most frequent ones."""
    if only is not None:
        picked = df.where(F.col(group).isin(list(only)))
    else:
        picked = df.join(largest_groups(df, [group], max_groups).select(group), group, "left_semi")
    return profile(picked, value, [group], min_samples)


def scoped_summary(df: DataFrame, value: str, surface: str, group: str) -> DataFrame:
    """Overall and per-group rows of the same statistics from one scan (grouping sets)."""
    x = F.col(value)
    scoped = df.groupingSets([[surface], [surface, group]], surface, group).agg(
        F.when(F.grouping(group) == 1, "overall").otherwise("by_group").alias("scope"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        adjusted_skew(value).alias("skew"),
        F.try_divide(F.count_if(x > 0), F.count(x)).alias("pos_ratio"),
        F.try_divide(F.count_if(x < 0), F.count(x)).alias("neg_ratio"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    whole = exact_quantiles(df, value, {"median": 0.5}, [surface]).withColumns(
        {"scope": F.lit("overall"), group: F.lit(None).cast("string")}
    )
    each = exact_quantiles(df, value, {"median": 0.5}, [surface, group]).withColumn("scope", F.lit("by_group"))
    return attach(scoped, whole.unionByName(each), ["scope", surface, group])


def directional_mae(df: DataFrame, residual: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE split by the sign of ``mask`` (pass the residual itself, or the raw one). NULL where empty."""
    e, m = F.abs(F.col(residual)), F.col(mask)
    return df.groupBy(*by).agg(
        F.count_if(m > 0).alias("pos_count"),
        F.count_if(m < 0).alias("neg_count"),
        F.avg(F.when(m > 0, e)).alias("pos_mae"),
        F.avg(F.when(m < 0, e)).alias("neg_mae"),
    )


def median_ordered(df: DataFrame, category: str, value: str, top: int = 15) -> DataFrame:
    """The most frequent categories with their medians and their place in median order."""
    names = largest_groups(df, [category], top).select(category)
    kept = df.join(names, category, "left_semi")
    med = exact_quantiles(kept, value, {"median": 0.5}, [category])
    # At most ``top`` rows reach this window.
    place = F.row_number().over(Window.orderBy("median", category))
    return med.withColumn("place", place)


def best_per_tag(df: DataFrame, tag: str, order: Sequence[Column]) -> DataFrame:
    """Whole best row per tag, by partial aggregation rather than by sorting each tag in one task. NULL and NaN rank last."""
    keys = []
    for i, c in enumerate(order):
        missing = c.isNull()
        if df.select(c.alias("_c")).schema["_c"].dataType.typeName() in ("double", "float"):
            missing = missing | F.isnan(c)
        keys += [missing.alias(f"_m{i}"), c.alias(f"_o{i}")]
    rank = F.struct(*keys)
    row = F.struct(*df.columns)
    return df.groupBy(tag).agg(F.min_by(row, rank).alias("_row")).select("_row.*")

