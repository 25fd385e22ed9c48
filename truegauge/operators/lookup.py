"""Bringing statistics back to the rows they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bring per-group statistics to the rows; one-row statistics arrive as a scalar subquery.

    No broadcast hint: the planner broadcasts when the measured size allows and otherwise
    shuffles, where adaptive execution splits hot keys.
    """
    fresh = [c for c in stats.columns if c not in by]
    if by:
        keys = {c: f"_k_{c}" for c in by}
        right = stats.withColumnsRenamed(keys)
        cond = [df[c].eqNullSafe(right[keys[c]]) for c in by]
        return df.join(right, cond, "left").drop(*keys.values())
    packed = stats.select(F.struct(*fresh).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in fresh])


def absent(stats: DataFrame, present: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``stats`` whose group has no row in ``present``; NULL is a group like any other, as in ``attach``."""
    keys = {c: f"_k_{c}" for c in by}
    right = present.select(*by).withColumnsRenamed(keys)
    cond = [stats[c].eqNullSafe(right[keys[c]]) for c in by]
    return stats.join(right, cond, "left_anti")
