"""Low-reading subset: incidence per time window and feature comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.lookup import attach

DAY = 86_400_000_000


def rate_columns(low: Column) -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("total"),
        F.count_if(low).alias("low"),
        F.round(F.count_if(low) * 100.0 / n, 2).alias("rate_pct"),
    ]


def incidence(df: DataFrame, ts: str, low: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of low readings per day, or per two hours when the data span less than two days.

    Rows without a time or without a reading do not count.
    """
    df = df.where(F.col(ts).isNotNull() & low.isNotNull())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = df.agg((F.max(micros) - F.min(micros)).alias("_span"))
    # Truncation follows the wall clock of the session zone, as a naive timestamp means it.
    two_hours = F.date_trunc("HOUR", ts) - F.make_dt_interval(F.lit(0), F.hour(ts) % 2)
    start = F.when(F.col("_span") >= 2 * DAY, F.date_trunc("DAY", ts)).otherwise(two_hours)
    placed = attach(df, span).withColumn("window_start", start)
    return placed.groupBy(*by, "window_start").agg(*rate_columns(low))
