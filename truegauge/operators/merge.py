"""Merging laboratory rows into the master table: prune, aggregate, join."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.scalar import join_key
from truegauge.session import fits_broadcast


@dataclass(frozen=True)
class SubTable:
    """How one sub table joins: its key, required columns, aggregate per column, kinds of matching."""

    df: DataFrame
    key: str
    columns: dict[str, str]
    required: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    unmatched: str = "keep"
    all_null: str = "keep"
    extra: dict[str, Column] = field(default_factory=dict)


def aggregate(strategy: str, column: str, order: Sequence[str]) -> Column:
    """Aggregate expression of a named strategy; unknown names mean ``mean``.

    ``first`` takes the first non-NULL value along ``order`` and ``sum`` of nothing is 0.
    """
    c = F.col(column)
    rank = F.struct(*[F.col(o) for o in order]) if order else F.lit(0)
    if strategy == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if strategy in ("max", "min"):
        return getattr(F, strategy)(c)
    if strategy == "first":
        return F.min_by(c, F.when(c.isNotNull(), rank))
    if strategy == "first_nonempty":
        return F.min_by(c, F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), rank))
    if strategy == "join_unique":
        return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ",")
    return F.avg(c)


def prune(sub: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    """Keep sub rows whose key exists in the master, before anything is aggregated."""
    wanted = master.select(join_key(master_key).alias("_wanted")).distinct()
    return sub.join(wanted, join_key(sub[key]) == F.col("_wanted"), "left_semi")


def aggregate_sub(sub: SubTable) -> DataFrame:
    """One row per key. ``required`` columns filter rows first, so they never reach the shuffle."""
    rows = sub.df.na.drop("any", subset=list(sub.required)) if sub.required else sub.df
    out = (
        rows.groupBy(join_key(sub.key).alias("_key"))
        .agg(*[aggregate(s, c, sub.order).alias(c) for c, s in sub.columns.items()])
        .where(F.col("_key").isNotNull())
    )
    return out.na.drop("all", subset=list(sub.columns)) if sub.all_null == "drop" else out


def merge_one(master: DataFrame, master_key: str, sub: SubTable, semi_prune: bool | None = None) -> DataFrame:
    """Equi-join the aggregated sub table; clashing names get ``_sub``, the sub key is dropped.

    Pruning first only pays while the master's keys fit a broadcast, which is the default test. A
    shuffled semi-join would send every raw row of a hot key to one task; without it the rows are
    pre-aggregated before they move, and the join prunes the rest. The result is the same.
    """
    pruned = sub
    if semi_prune is None:
        semi_prune = fits_broadcast(master.select(master_key))
    if semi_prune:
        pruned = SubTable(**{**sub.__dict__, "df": prune(sub.df, sub.key, master, master_key)})
    right = aggregate_sub(pruned)
    right = right.withColumnsRenamed({c: f"{c}_sub" for c in sub.columns if c in master.columns})
    how = "inner" if sub.unmatched == "drop" else "left"
    return master.join(right, join_key(master[master_key]) == right["_key"], how).drop("_key")


def merge_all(master: DataFrame, master_key: str, subs: Sequence[SubTable]) -> DataFrame:
    return functools.reduce(lambda m, s: merge_one(m, master_key, s), subs, master)


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once; the union of batches does not remove them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
