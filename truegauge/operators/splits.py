"""Train/test splits by order, by hash, and expanding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.operators.ordered import running_totals


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """0-based ``_i`` and group size ``_n``."""
    out = running_totals(df, by, order, {"_i": F.lit(1).cast("long")}, overall=True)
    return out.withColumnRenamed("_i_all", "_n").withColumn("_i", F.col("_i") - 1)


def ordered_holdout(df: DataFrame, order: Sequence[str], test_size: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """``role``: the last ``ceil(test_size * n)`` rows of each group are ``test``."""
    out = numbered(df, order, by)
    cut = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size))
    return out.withColumn("role", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i", "_n")


def random_holdout(df: DataFrame, key: str, test_size: float, seed: int) -> DataFrame:
    """Reproducible split by key hash, independent of partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) / 10_000.0
    return df.withColumn("role", F.when(share < test_size, "test").otherwise("train"))


def expanding_windows(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    splits: int = 3,
    train_ratio: float = 0.7,
    last_share: float = 0.15,
    last_rows: int = 20,
    min_train: int = 30,
    min_rows: int = 50,
) -> DataFrame:
    """Rows of every usable ``(fold, role)``. Groups below ``min_rows`` get the plain ordered holdout as fold 0."""
    out = numbered(df, order, by)
    n, i, k = F.col("_n"), F.col("_i"), F.col("fold") - 1
    start = F.floor(n * F.lit(train_ratio))
    step = F.greatest(F.floor((n - start) / F.lit(splits)), F.lit(1).cast("long"))
    last = F.col("fold") == splits
    train_end = F.when(last, n - F.greatest(F.floor(n * F.lit(last_share)), F.lit(last_rows).cast("long"))).otherwise(start + k * step)
    test_end = F.when(last, n).otherwise(F.least(train_end + step, n))
    folds = (
        out.where(n >= min_rows)
        .withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(1, splits + 1)])))
        .where((i < test_end) & (train_end < test_end) & (train_end >= min_train))
        .withColumn("role", F.when(i < train_end, "train").otherwise("test"))
    )
    cut = n - F.ceil(n * F.lit(0.2))
    small = out.where(n < min_rows).withColumns({"fold": F.lit(0), "role": F.when(i < cut, "train").otherwise("test")})
    return folds.unionByName(small).drop("_i", "_n")


def last_fold(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Only the rows of each group's last window, the one that is reported."""
    keys = list(by)
    top = windows.groupBy(*keys).agg(F.max("fold").alias("fold"))
    return windows.join(top, [*keys, "fold"], "left_semi")
