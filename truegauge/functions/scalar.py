"""Column expressions: cleaning of text and numbers, labels, time, feature formulas."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.spec import EPSILON, NULL_TOKENS


def finite(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c)  # NaN sorts above every number in Spark


def finite_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating column, as done once at ingest."""
    return df.withColumns({n: finite(F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def null_tokens(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    return F.when(~text.isin(*NULL_TOKENS), text)


def number(c: Column | str) -> Column:
    """Coerce dirty numeric text to double; anything unreadable is NULL."""
    return finite(null_tokens(c).try_cast("double"))


def clean_text(c: Column | str) -> Column:
    """Drop line breaks and surrounding blanks."""
    return F.trim(F.regexp_replace(c, r"[\r\n]", ""))


def safe_name(c: Column | str, limit: int = 60) -> Column:
    """File-safe label: separators become ``_``, brackets go, at most ``limit`` characters."""
    return F.substring(F.translate(c, "/\\ []()", "___"), 1, limit)


def join_key(c: Column | str) -> Column:
    """Text form of a key without surrounding blanks; NULL stays NULL and matches nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string"))


def row_sum(columns: Sequence[str], min_count: int = 0) -> Column:
    """Sum across columns that skips NULL; 0 when all are NULL unless ``min_count`` asks for values."""
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    if not min_count:
        return total
    present = functools.reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.when(present >= min_count, total)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with NULL for a zero divisor or a non-finite result."""
    return finite(F.try_divide(a, F.nullif(b, F.lit(0.0))))


def epsilon_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(EPSILON))


def setpoint_label(top: str, bot: str) -> Column:
    """``Top2.8_Bot1.1`` from the exact values."""
    return F.concat(F.lit("Top"), F.col(top).cast("string"), F.lit("_Bot"), F.col(bot).cast("string"))


def setpoint_label_or_unknown(top: str, bot: str) -> Column:
    return F.when(F.col(top).isNull() | F.col(bot).isNull(), F.lit("Unknown")).otherwise(
        F.concat_ws("_", F.lit("Top"), F.col(top).cast("string"), F.lit("Bot"), F.col(bot).cast("string"))
    )


def elapsed_days(ts: Column, start: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)


def effect_label(c: Column) -> Column:
    """Verbal size of Cliff's delta (fixed cut points 0.147 / 0.33 / 0.474)."""
    size = F.abs(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(size < 0.147, "negligible")
        .when(size < 0.33, "small")
        .when(size < 0.474, "medium")
        .otherwise("large")
    )


def resolve_delta(columns: Iterable[str], delta: str | None, truth: str, predicted: str | None, online: str) -> Column:
    """Pick the delta source: a given column, else truth - prediction, else truth - online."""
    have = set(columns)
    if delta and delta in have:
        return F.col(delta)
    if predicted and {truth, predicted} <= have:
        return F.col(truth) - F.col(predicted)
    if {truth, online} <= have:
        return F.col(truth) - F.col(online)
    raise ValueError("no column to take delta from")


def infer_time_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a timestamp, or text of which at least one row parses as one."""
    types = dict(df.dtypes)
    for name in candidates:
        if types.get(name, "").startswith(("timestamp", "date")):
            return name
        if types.get(name) == "string" and df.where(F.try_to_timestamp(F.col(name)).isNotNull()).limit(1).count():
            return name
    return None


def infer_by_substring(columns: Iterable[str], *needles: str) -> str | None:
    """First column whose lower-cased name holds every needle."""
    return next((c for c in columns if all(n.lower() in c.lower() for n in needles)), None)


def infer_feature_kinds(df: DataFrame, columns: Sequence[str], max_unique: int = 15, approximate: bool = False) -> DataFrame:
    """``(feature, distinct_values, kind)``: text, and numbers with few values, are categorical.

    One pass for all columns; with ``approximate`` no distinct set is shuffled at all.
    """
    types = dict(df.dtypes)
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "feature", "distinct_values")
    textual = [c for c in columns if types[c] in ("string", "boolean")]
    return long.withColumn(
        "kind",
        F.when(F.col("feature").isin(textual) | (F.col("distinct_values") <= max_unique), "categorical").otherwise("numeric"),
    )
