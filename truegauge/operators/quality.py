"""Row rules with explainable reasons, outlier policies and gates."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles
from truegauge.session import materialise
from truegauge.spec import EPSILON, CleaningRules, Spec, Surface


def holds(c: Column) -> Column:
    """A comparison with a missing value is false, not unknown."""
    return F.coalesce(c, F.lit(False))


def any_null(columns: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def low_speed(spec: Spec, rules: CleaningRules) -> Column:
    return holds(F.col(spec.speed) <= rules.min_speed)


def dead_gauge(s: Surface) -> Column:
    return holds(F.col(s.online_min) <= 0) | holds(F.col(s.online) <= 0)


def unstable_gauge(s: Surface, rules: CleaningRules) -> Column:
    spread = F.col(s.online_max) - F.col(s.online_min)
    return holds(spread > rules.max_range_abs) | holds(
        F.try_divide(spread, F.col(s.online) + F.lit(EPSILON)) > rules.max_range_ratio
    )


def row_rules(spec: Spec, rules: CleaningRules, required: Sequence[str]) -> dict[str, Column]:
    """Rules that look at one row only, in reporting order; usable on streams as they are."""
    made = {"missing required value": any_null(required), "speed at or below minimum": low_speed(spec, rules)}
    for s in spec.surfaces:
        made[f"{s.name} gauge dead"] = dead_gauge(s)
    for s in spec.surfaces:
        made[f"{s.name} gauge unstable"] = unstable_gauge(s, rules)
    return made


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that fired, joined in order; empty for a good row."""
    return F.concat_ws("; ", *[F.when(cond, F.lit(name)) for name, cond in rules.items()])


def mad_limits(df: DataFrame, value: str, rules: CleaningRules, by: Sequence[str] = ()) -> DataFrame:
    """``(centre, limit)`` per group: median and scaled median absolute deviation times the factor."""
    by = list(by)
    centre = exact_quantiles(df, value, {"centre": 0.5}, by)
    spread = attach(df.select(*by, value), centre, by).select(*by, F.abs(F.col(value) - F.col("centre")).alias("_dev"))
    mad = exact_quantiles(spread, "_dev", {"_mad": 0.5}, by)
    return attach(centre, mad, by).select(
        *by, "centre", (F.col("_mad") * F.lit(rules.mad_scale * rules.mad_factor)).alias("limit")
    )


def flag_rows(df: DataFrame, spec: Spec, rules: CleaningRules, required: Sequence[str], deltas: dict[str, str]) -> DataFrame:
    """Add ``filter_reason``. Residual outliers are measured and flagged only among rows no earlier rule hit."""
    # Written once: the merge behind ``df`` is the expensive part, and the clean set, the rejected set and
    # the medians all read from here. Medians of all surfaces share two passes over the delta columns.
    flagged = materialise(df.withColumn("filter_reason", reasons(row_rules(spec, rules, required))), "flagged")
    survivors = (
        flagged.where(F.col("filter_reason") == "")
        .select(*deltas.values())
        .unpivot([], list(deltas.values()), "_delta", "_x")
    )
    limits = {r["_delta"]: r for r in mad_limits(survivors, "_x", rules, ["_delta"]).collect()}  # one row per surface
    late = {
        f"{name} residual outlier": holds(F.abs(F.col(delta) - F.lit(limits[delta]["centre"])) > F.lit(limits[delta]["limit"]))
        for name, delta in deltas.items()
        if delta in limits
    }
    if not late:
        return flagged
    return flagged.withColumn(
        "filter_reason", F.when(F.col("filter_reason") == "", reasons(late)).otherwise(F.col("filter_reason"))
    )


def sigma_rule(
    df: DataFrame, value: str, speed: str, rules: CleaningRules, out: str, required: Sequence[str] = ()
) -> DataFrame:
    """Flag values beyond k sample deviations of the mean while the line runs in steady state.

    Mean and deviation come from the rows that have every required column.
    """
    stats = (df.na.drop("any", subset=list(required)) if required else df).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    far = F.abs(F.col(value) - F.col("_mean")) > F.lit(rules.sigma_factor) * F.col("_std")
    return attach(df, stats).withColumn(out, holds((F.col(speed) > rules.steady_speed) & far)).drop("_mean", "_std")


def residual_outliers(df: DataFrame, residual: str, by: Sequence[str] = (), factor: float = 3.0) -> DataFrame:
    """``is_outlier``: beyond ``factor`` sample deviations of the mean, overall or per group."""
    stats = df.groupBy(*by).agg(F.avg(residual).alias("_mean"), F.stddev_samp(residual).alias("_std"))
    return (
        attach(df, stats, by)
        .withColumn("is_outlier", holds(F.abs(F.col(residual) - F.col("_mean")) > F.lit(factor) * F.col("_std")))
        .drop("_mean", "_std")
    )


def cleaning_summary(flagged: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("filter_reason") != "")
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("total"), bad.alias("rejected"), (bad / n * 100).alias("rejected_pct"), (n - bad).alias("kept")
    )


def reason_counts(flagged: DataFrame) -> DataFrame:
    return (
        flagged.where(F.col("filter_reason") != "")
        .select(F.explode(F.split("filter_reason", "; ")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def group_status(df: DataFrame, by: Sequence[str], min_samples: int) -> DataFrame:
    """Group sizes with ``modelled`` / ``skipped`` by the size gate."""
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("samples"))
        .withColumn("status", F.when(F.col("samples") >= min_samples, "modelled").otherwise("skipped"))
    )


def keep_groups(df: DataFrame, by: Sequence[str], min_samples: int) -> DataFrame:
    ok = group_status(df, by, min_samples).where(F.col("status") == "modelled").select(*by)
    return df.join(ok, list(by), "left_semi")


def missing_and_outlier_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: missing share, and share outside the 1.5 IQR fences (only where the IQR is positive)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "x")
    q = exact_quantiles(long, "x", {"q1": 0.25, "q3": 0.75}, ["feature"])
    iqr = F.col("q3") - F.col("q1")
    outside = holds((iqr > 0) & ((F.col("x") < F.col("q1") - 1.5 * iqr) | (F.col("x") > F.col("q3") + 1.5 * iqr)))
    n = F.count(F.lit(1))
    return attach(long, q, ["feature"]).groupBy("feature").agg(
        n.alias("rows"),
        (F.count_if(F.col("x").isNull()) / n).alias("missing_rate"),
        (F.count_if(outside) / n).alias("outlier_rate"),
    )
