"""Feature derivation on the coil grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.scalar import epsilon_ratio, ratio, row_sum, setpoint_label
from truegauge.operators.lookup import attach
from truegauge.spec import Spec


def derive(df: DataFrame, spec: Spec, training: bool = False) -> DataFrame:
    """Current sums, current per speed, theoretical factor, setpoint deviation and delta per surface.

    ``training`` selects the epsilon-guarded current/speed ratio used when models are fitted.
    """
    made = {"width_m": F.col(spec.width_mm) / 1000.0}
    speed = F.col(spec.speed)
    for s in spec.surfaces:
        total = row_sum(s.currents)
        made[s.col("current_sum")] = total
        made[s.col("current_per_speed")] = (
            epsilon_ratio(total, F.nullif(speed, F.lit(0.0))) if training else ratio(total, speed)
        )
        made[s.col("factor")] = ratio(total, speed * (F.col(spec.width_mm) / 1000.0))
        made[s.col("deviation")] = F.col(s.setpoint) - F.col(s.online)
        if s.truth in df.columns:
            made[s.col("delta")] = F.col(s.truth) - F.col(s.online)
    if len(spec.surfaces) == 2:
        made["setpoint_group"] = setpoint_label(spec.surfaces[0].setpoint, spec.surfaces[1].setpoint)
    return df.withColumns(made)


def centre(df: DataFrame, columns: list[str]) -> DataFrame:
    """Subtract each column's mean over all rows, those later rejected included."""
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return (
        attach(df, means)
        .withColumns({f"{c}_centred": F.col(c) - F.col(f"_mean_{c}") for c in columns})
        .drop(*means.columns)
    )


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Share of each category among the non-NULL rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return attach(counts, total).select(column, (F.col("_n") / F.col("_total")).alias("frequency"))


def encode_frequency(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """Look categories up in a frequency table; unseen and NULL categories encode as 0."""
    renamed = table.select(F.col(column).alias("_category"), F.col("frequency").alias("_frequency"))
    joined = df.join(renamed, df[column] == renamed["_category"], "left")
    return joined.withColumn(out, F.coalesce("_frequency", F.lit(0.0))).drop("_category", "_frequency")


def surfaces_long(df: DataFrame, spec: Spec, shared: list[str], measures: list[str]) -> DataFrame:
    """One row per coil and surface; grouping by ``(surface, group)`` then covers both sides in one pass."""
    picked = []
    for s in spec.surfaces:
        fields = [F.lit(s.name).alias("surface")]
        for m in measures:
            source = {"online": s.online, "truth": s.truth, "setpoint": s.setpoint}.get(m, s.col(m))
            fields.append(F.col(source).cast("double").alias(m))
        picked.append(F.struct(*fields))
    return df.select(*shared, F.inline(F.array(*picked)))
