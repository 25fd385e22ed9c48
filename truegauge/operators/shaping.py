"""Sorting with custom orders, shares of a ranking, tagged unions, melt, pivot and transpose."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.ordered import running_totals, with_ordinal


def sort_by_size(df: DataFrame, value: str, *tie: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), *tie)


def custom_order(c: Column, names: Sequence[str]) -> Column:
    """Place of a text in a fixed list, unknown texts last."""
    expr = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        expr = F.when(c == n, i).otherwise(expr)
    return expr


def smallest_share(df: DataFrame, order: Sequence[str], share: float, at_least: int) -> DataFrame:
    """The rows ranking among the lowest ``max(int(n * share), at_least)``; a total order decides ties."""
    ranked = running_totals(df, [], order, {"_rank": F.lit(1).cast("long")}, overall=True)
    take = F.greatest(F.floor(F.col("_rank_all") * F.lit(share)), F.lit(at_least))
    return ranked.where(F.col("_rank") <= take).select(*df.columns)


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    tagged = [d.withColumn(tag, F.lit(n)) for n, d in parts.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, rows: Sequence[str], column: str, value: str, names: Sequence, how: str = "avg") -> DataFrame:
    """Wide table with the named columns only: no extra job to discover them."""
    return df.groupBy(*rows).pivot(column, list(names)).agg(getattr(F, how)(value))


def transpose(df: DataFrame, index: str, names: Sequence[str]) -> DataFrame:
    """Report tables: rows named by ``index`` become the columns ``names``."""
    values = [c for c in df.columns if c != index]
    return melt(df, [index], values, "field").groupBy("field").pivot(index, list(names)).agg(F.first("value"))


def thin(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows evenly spaced in order, first and last included."""
    numbered = running_totals(df, [], order, {"_rank": F.lit(1).cast("long")}, overall=True)
    last, i, steps = F.col("_rank_all") - 1, F.col("_rank") - 1, k - 1
    j = F.floor((i * steps + last - 1) / last)
    hit = F.floor(j * last / F.lit(steps)) == i
    return numbered.where((F.col("_rank_all") <= k) | hit).select(*df.columns)


def common_keys(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def ordered_series(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns with their dense position, for line charts."""
    return with_ordinal(df, order, name="position").select("position", *columns)
