"""Ordered operators that never put a whole group (or the whole table) into one task.

Everything rests on one layout step: rows are range-partitioned by ``(by..., order...)`` and
written once with their partition number. A group of any size then spans as many partitions as
it needs. A running value is the sum of

* a window inside ``(partition, group)``, whose size is bounded by the partition, and
* a carry from earlier partitions, computed on one summary row per ``(partition, group)``.

Operators with a bounded memory (rolling frames, lags) use the ordinal instead: fixed-size blocks
of consecutive rows, with the few rows a frame reaches over the border copied into the next block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.operators.lookup import attach
from truegauge.session import materialise

BLOCK_ROWS = 1 << 16
PART = "_part"
GROUP = "_group"


def lay_out(df: DataFrame, by: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by group and order and pin the layout; adds the partition number."""
    keys = [F.col(c) for c in [*by, *order]]
    moved = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return materialise(moved.withColumn(PART, F.spark_partition_id()), "ordered")


def group_key(by: Sequence[str]) -> Column:
    """All group columns as one value. Equal structs may hold NULLs, so a plain equi-join on it
    treats NULL as a group of its own and keeps the hash partitioning of the window before it."""
    return F.struct(*[F.col(c) for c in by]) if by else F.lit(0)


def _with_carry(local: DataFrame, carry: DataFrame) -> DataFrame:
    left, right = local.alias("l"), carry.alias("c")
    return left.join(
        right, (F.col(f"l.{PART}") == F.col(f"c.{PART}")) & (F.col(f"l.{GROUP}") == F.col(f"c.{GROUP}")), "left"
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    partitions: int | None = None,
    overall: bool = False,
) -> DataFrame:
    """Inclusive running sum of each expression within ``by`` along ``order``.

    ``order`` must be a total order within a group. NULL terms count as zero. ``overall`` adds
    ``<name>_all``, the sum over the whole group, from the same summary.
    """
    by = list(by)
    terms = {name: f"_term_{i}" for i, name in enumerate(totals)}
    prepared = df.withColumns({terms[n]: F.coalesce(e, F.lit(0).cast("long")) for n, e in totals.items()})
    laid = lay_out(prepared, by, order, partitions).withColumn(GROUP, group_key(by))

    inner = Window.partitionBy(PART, GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({n: F.sum(terms[n]).over(inner) for n in totals})

    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        laid.groupBy(PART, GROUP)
        .agg(*[F.sum(t).alias(t) for t in terms.values()])
        .withColumns({f"_carry{t}": F.sum(t).over(earlier) for t in terms.values()})
    )
    if overall:
        carry = carry.withColumns({f"_all{t}": F.sum(t).over(Window.partitionBy(GROUP)) for t in terms.values()})
    else:
        carry = carry.where(F.col(f"_carry{next(iter(terms.values()))}").isNotNull())
    carry = carry.drop(*terms.values())
    joined = _with_carry(local, carry)
    kept = [F.col(f"l.{c}").alias(c) for c in df.columns]
    return joined.select(
        *kept,
        *[(F.col(f"l.{n}") + F.coalesce(F.col(f"c._carry{t}"), F.lit(0).cast("long"))).alias(n) for n, t in terms.items()],
        *([F.col(f"c._all{t}").alias(f"{n}_all") for n, t in terms.items()] if overall else []),
    )


def running_extreme(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    fn: str = "min",
    strictly_before: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Running minimum or maximum along ``order``, optionally of the earlier rows only."""
    by, reduce, merge = list(by), getattr(F, fn), F.least if fn == "min" else F.greatest
    laid = lay_out(df, by, order, partitions).withColumn(GROUP, group_key(by))
    inner = Window.partitionBy(PART, GROUP).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if strictly_before else 0
    )
    local = laid.withColumn(out, reduce(value).over(inner))
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = laid.groupBy(PART, GROUP).agg(reduce(value).alias("_end")).withColumn("_end", reduce("_end").over(earlier))
    joined = _with_carry(local, carry)
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns], merge(F.col(f"l.{out}"), F.col("c._end")).alias(out)
    )


def with_ordinal(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Dense 0-based row number within ``by`` (the whole table when empty)."""
    out = running_totals(df, by, order, {name: F.lit(1).cast("long")}, partitions)
    return out.withColumn(name, F.col(name) - 1)


def forward_fill(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str],
    by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Replace NULLs by the last non-NULL value before them within the group."""
    by = list(by)
    laid = lay_out(df, by, order, partitions).withColumn(GROUP, group_key(by))
    inner = Window.partitionBy(PART, GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in columns})

    rank = F.struct(*[F.col(c) for c in order])
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        laid.groupBy(PART, GROUP)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_end_{c}") for c in columns])
        .withColumns({f"_end_{c}": F.last(f"_end_{c}", ignorenulls=True).over(earlier) for c in columns})
    )
    joined = _with_carry(local, carry)
    return joined.select(
        *[
            F.coalesce(F.col(f"l.{c}"), F.col(f"c._end_{c}")).alias(c) if c in columns else F.col(f"l.{c}").alias(c)
            for c in df.columns
        ]
    )


def in_blocks(df: DataFrame, idx: str, back: int, ahead: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks of ``size`` consecutive ordinals; copy border rows a frame can reach."""
    size = max(size, 4 * (back + ahead))
    first = F.greatest(F.floor((F.col(idx) - ahead) / size), F.lit(0).cast("long"))
    last = F.floor((F.col(idx) + back) / size)
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.floor(F.col(idx) / size) == F.col("_blk")
    )


def rolling(
    df: DataFrame,
    order: Sequence[str],
    aggs: dict[str, Column],
    back: int,
    ahead: int = 0,
    by: Sequence[str] = (),
    idx: str | None = None,
    size: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Evaluate aggregate expressions over ``rowsBetween(-back, ahead)`` within each group."""
    numbered = df if idx else with_ordinal(df, order, by, "_idx", partitions)
    name = idx or "_idx"
    blocks = in_blocks(numbered, name, back, ahead, size)
    frame = Window.partitionBy(*by, "_blk").orderBy(name).rowsBetween(-back, ahead)
    out = blocks.withColumns({n: e.over(frame) for n, e in aggs.items()}).where("_own")
    return out.select(*df.columns, *aggs)


def rolling_stats(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    window: int = 50,
    min_periods: int | None = None,
    **kw,
) -> DataFrame:
    """Trailing mean and sample deviation over ``window`` rows, NULL below ``min_periods`` values."""
    need = max(10, window // 4) if min_periods is None else min_periods
    out = rolling(
        df,
        order,
        {"_n": F.count(value), "roll_mean": F.avg(value), "roll_std": F.stddev_samp(value)},
        back=window - 1,
        by=by,
        **kw,
    )
    enough = F.col("_n") >= need
    return out.withColumns(
        {"roll_mean": F.when(enough, F.col("roll_mean")), "roll_std": F.when(enough, F.col("roll_std"))}
    ).drop("_n")


def rolling_centred(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    window: int,
    by: Sequence[str] = (),
    min_periods: int = 5,
    **kw,
) -> DataFrame:
    """Centred mean: ``window // 2`` rows back, ``(window - 1) // 2`` ahead."""
    out = rolling(
        df, order, {"_n": F.count(value), "trend": F.avg(value)}, back=window // 2, ahead=(window - 1) // 2, by=by, **kw
    )
    return out.withColumn("trend", F.when(F.col("_n") >= min_periods, F.col("trend"))).drop("_n")


def trend_line(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    share: int = 50,
    least: int = 20,
    min_periods: int = 5,
    min_rows: int = 51,
    partitions: int | None = None,
) -> DataFrame:
    """Centred mean whose window grows with the group, ``max(least, n // share)`` rows.

    Such a window outgrows any block, so it is the difference of two running totals, looked up by
    ordinal. NULL in groups below ``min_rows`` and where fewer than ``min_periods`` values fall in.
    """
    by = list(by)
    means = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    centred = attach(df, means, by).withColumn("_x", F.col(value) - F.col("_m"))
    terms = {"_i": F.lit(1).cast("long"), "_s": F.col("_x"), "_c": F.col(value).isNotNull().cast("long")}
    run = materialise(running_totals(centred, by, order, terms, partitions, overall=True), "trend").withColumn(GROUP, group_key(by))
    n, i = F.col("_i_all"), F.col("_i")
    width = F.greatest(F.lit(least).cast("long"), F.floor(n / share))
    ends = run.withColumns(
        {"_hi": F.least(i + F.floor((width - 1) / 2), n), "_lo": F.greatest(i - F.floor(width / 2) - 1, F.lit(0).cast("long"))}
    )
    at = run.select(GROUP, "_i", "_s", "_c")
    hi = at.select(F.col(GROUP), F.col("_i").alias("_hi"), F.col("_s").alias("_s1"), F.col("_c").alias("_c1"))
    lo = at.select(F.col(GROUP), F.col("_i").alias("_lo"), F.col("_s").alias("_s0"), F.col("_c").alias("_c0"))
    both = ends.join(hi, [GROUP, "_hi"]).join(lo, [GROUP, "_lo"], "left")
    count = F.col("_c1") - F.coalesce("_c0", F.lit(0))
    total = F.col("_s1") - F.coalesce("_s0", F.lit(0.0))
    trend = F.when((n >= min_rows) & (count >= min_periods), F.col("_m") + total / count)
    return both.select(*df.columns, trend.alias("trend"))


def lagged(df: DataFrame, value: str, lags: int, order: Sequence[str], by: Sequence[str] = (), idx: str | None = None, **kw) -> DataFrame:
    """Add ``lag_1 .. lag_k`` of ``value``."""
    numbered = df if idx else with_ordinal(df, order, by, "_idx", kw.get("partitions"))
    name = idx or "_idx"
    blocks = in_blocks(numbered, name, lags, 0, kw.get("size", BLOCK_ROWS))
    frame = Window.partitionBy(*by, "_blk").orderBy(name)
    made = {f"lag_{k}": F.lag(value, k).over(frame) for k in range(1, lags + 1)}
    return blocks.withColumns(made).where("_own").select(*df.columns, *made)


def ewma(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    alpha: float,
    by: Sequence[str] = (),
    out: str = "smoothed",
    seed: str | None = None,
    seed_weight: str | None = None,
    weight_out: str | None = None,
    idx: str | None = None,
    partitions: int | None = None,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Adjusted exponentially weighted mean, ``sum(b^i x[t-i]) / sum(b^i)`` with ``b = 1 - alpha``.

    Weights older than K rows are below e^-45, so a block of consecutive rows with the K rows before
    it is self-contained: inside, the sum is a plain running sum of ``x * b^-pos``, with the block
    length chosen to keep the weights in double range. ``seed`` names a column holding, per group, one
    earlier smoothed value that counts as a single observation before the first row; with
    ``seed_weight`` it counts with that weight, which continues an earlier series exactly when the
    weight is the one ``weight_out`` reported for its last row. A NULL row takes the value of the last row
    that has one, however far back it is (the mean doesn't change while weights only decay), else the seed.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return df.withColumns({out: F.col(value), **({weight_out: F.lit(1.0)} if weight_out else {})})
    by = list(by)
    beta = 1.0 - alpha
    rate = -math.log(beta)
    back = math.ceil(45 / rate)
    rows = max(1, int(550 / rate))
    numbered = df if idx else with_ordinal(df, order, by, "_idx", partitions)
    name = idx or "_idx"
    b, x = F.lit(beta), F.col(value).cast("double")
    block = max(min(rows, size), 4 * back)
    first = F.greatest(F.col("_blk") * block - back, F.lit(0).cast("long"))
    placed = in_blocks(numbered, name, back, 0, block).withColumn("_pos", (F.col(name) - first).cast("double"))
    frame = Window.partitionBy(*by, "_blk").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    grow, fade = F.pow(b, -F.col("_pos")), F.pow(b, F.col("_pos"))
    sparse = not numbered.where(x.isNull()).isEmpty()
    local = placed.withColumns(
        {
            "_num": fade * F.sum(F.coalesce(x, F.lit(0.0)) * grow).over(frame),
            "_den": fade * F.sum(x.isNotNull().cast("double") * grow).over(frame),
        }
    ).where("_own")
    num, den = F.col("_num"), F.col("_den")
    if seed:
        age = F.pow(b, F.col(name).cast("double") + 1)
        mass = F.coalesce(F.col(seed_weight), F.lit(0.0)) if seed_weight else F.lit(1.0)
        num = num + F.coalesce(F.col(seed), F.lit(0.0)) * mass * age
        den = den + F.col(seed).isNotNull().cast("double") * mass * age
    mean = F.try_divide(num, F.nullif(den, F.lit(0.0)))
    if sparse:
        # The last present value of a block reaches its later NULL rows by a window, those of later blocks by a fill over block ends.
        keep = dict.fromkeys([*df.columns, *by, name, "_blk"])
        local = materialise(local.select(*keep, mean.alias("_mean"), den.alias("_mass_at")), "ewma")
        seen = F.when(F.col(value).isNotNull(), F.struct(F.col("_mean"), F.col("_mass_at"), F.col(name).alias("_at")))
        ends = local.groupBy(*by, "_blk").agg(F.max_by(seen, F.when(F.col(value).isNotNull(), F.col(name))).alias("_end"))
        # What a block starts from is the end of the block before it, or what that one started from.
        ends = ends.withColumn("_blk", F.col("_blk") + 1)
        starts = forward_fill(ends.unionByName(local.groupBy(*by, "_blk").agg(F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"))).groupBy(*by, "_blk").agg(F.max("_end").alias("_end")), ["_blk"], ["_end"], by)
        within = F.last(seen, ignorenulls=True).over(frame)
        local = attach(local.withColumn("_seen", within), starts.withColumnRenamed("_end", "_before"), [*by, "_blk"])
        kept = F.coalesce("_seen", "_before")
        mean = F.coalesce(kept["_mean"], *([F.col(seed).cast("double")] if seed else []))
        den = F.coalesce(kept["_mass_at"] * F.pow(b, (F.col(name) - kept["_at"]).cast("double")), F.col("_mass_at"))
    return local.select(
        *df.columns,
        mean.alias(out),
        *([den.alias(weight_out)] if weight_out else []),
    )
