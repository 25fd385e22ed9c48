"""Model interpretation as row expansion: score once, aggregate by feature."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.boosting import MODEL_BYTES, BoostedTrees, Forest
from truegauge.operators.ordered import with_ordinal
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles
from truegauge.session import materialise

Predict = Callable[[DataFrame], DataFrame]


def permutation_importance(
    df: DataFrame, predict: Predict, features: Sequence[str], label: str, key: str, repeats: int = 15, seed: int = 42
) -> DataFrame:
    """Increase of MAE when one feature is shuffled: mean and deviation over ``repeats``.

    A shuffle is a join of two dense row numbers, one along the key and one along a seeded hash,
    so every repeat is a true permutation of the whole table. All repeats and features are scored
    by one transform.
    """
    slim = materialise(df.select(key, *features, label), "importance")
    base = slim.select(F.avg(F.abs(F.col(label) - F.col("predicted_delta"))).alias("_base")) if "predicted_delta" in slim.columns else (
        predict(slim).agg(F.avg(F.abs(F.col(label) - F.col("predicted_delta"))).alias("_base"))
    )
    rep = F.explode(F.array(*[F.lit(i) for i in range(repeats)]))
    plain = with_ordinal(slim, [key], name="_i").withColumn("_rep", rep)
    mixed = with_ordinal(
        slim.select(key, *features).withColumn("_rep", rep).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_rep"), F.col(key))),
        ["_h", key], ["_rep"], "_i",
    )
    donors = mixed.select("_rep", "_i", *[F.col(c).alias(f"_d_{c}") for c in features])
    both = plain.join(donors, ["_rep", "_i"]).withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in features])))
    swapped = both.withColumns({c: F.when(F.col("_feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in features})
    scored = predict(swapped.drop(*[f"_d_{c}" for c in features]))
    per = scored.groupBy("_feature", "_rep").agg(F.avg(F.abs(F.col(label) - F.col("predicted_delta"))).alias("_mae"))
    return (
        attach(per, base)
        .groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg(F.col("_mae") - F.col("_base")).alias("importance"), F.stddev_pop(F.col("_mae") - F.col("_base")).alias("std"))
        .orderBy(F.desc("importance"))
    )


def shapley_values(
    df: DataFrame, predict: Predict, features: Sequence[str], key: str, permutations: int = 8, background: int | None = None, seed: int = 42
) -> DataFrame:
    """Sampled Shapley values ``(key, feature, x, phi)`` of any model. For boosted trees :func:`tree_shapley` is exact.

    For each sampled feature order a row turns from a background row into itself, one feature at a
    time. Every step is scored, and the change a step makes belongs to the feature it switched. Per
    order the contributions add up exactly to ``f(row) - f(background row)``. Every (row, order) has a background row of
    its own, drawn from the whole table by its number; ``background`` draws from that many rows only.
    """
    d = len(features)
    rng = random.Random(seed)
    orders = [rng.sample(range(d), d) for _ in range(permutations)]
    places = F.array(*[F.array(*[F.lit(o.index(i)) for i in range(d)]) for o in orders])
    slim = df.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    pool = slim.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    pool = materialise(pool.orderBy("_h", key).limit(background) if background else pool, "background")
    size = F.count(F.lit(1)).alias("_size")
    drawn = pool.select("_h", F.col(key).alias("_k"), *[F.col(c).alias(f"_b_{c}") for c in features])
    numbered = with_ordinal(drawn, ["_h", "_k"], name="_slot").drop("_h", "_k")
    rows = attach(slim, pool.agg(size)).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("_perm")), F.col("_size")))
    paired = rows.join(numbered, "_slot").withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    place = F.element_at(places, F.col("_perm") + 1)
    mixed = paired.withColumn("_place", place).withColumns({f"_x_{c}": F.col(c) for c in features})
    mixed = mixed.withColumns(
        {c: F.when(F.element_at("_place", i + 1) < F.col("_step"), F.col(f"_x_{c}")).otherwise(F.col(f"_b_{c}")) for i, c in enumerate(features)}
    )
    scored = predict(mixed)
    share = []
    for i, c in enumerate(features):
        at = F.element_at("_place", i + 1)
        sign = F.when(F.col("_step") == at + 1, 1.0).when(F.col("_step") == at, -1.0)
        share.append(F.struct(F.lit(c).alias("feature"), F.col(f"_x_{c}").alias("x"), (sign * F.col("predicted_delta")).alias("part")))
    long = scored.select(key, F.inline(F.array(*share))).where(F.col("part").isNotNull())
    return long.groupBy(key, "feature").agg(F.first("x").alias("x"), (F.sum("part") / F.lit(float(permutations))).alias("phi"))


def forest_shapley(forest: Forest, slot: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of every row's prediction, one column a feature, against the training rows as the trees' covers count them.

    A leaf is reached with "weight" ``prod_j (o_j if j is known else z_j)`` over the features of its path: ``o_j`` tells whether the row agrees with all its splits on
    ``j``, ``z_j`` is the share of training rows that do. The Shapley value of such a product is the integral over t in (0, 1) of ``(o_j - z_j) prod_{i != j} (z_i (1 - t)
    + o_i t)``, a polynomial, which Gauss-Legendre points give exactly. All rows of a batch go through a leaf at once.
    """
    out = np.zeros(x.shape)
    for s in np.unique(slot):
        own = np.flatnonzero(slot == s)
        part = x[own]
        for t in range(forest.feature.shape[1]):
            feature, value, cover = forest.feature[s, t], forest.value[s, t], forest.cover[s, t]
            if feature[0] < 0:
                continue
            left = {}
            stack = [(0, {})]  # node, feature -> (agreement of the rows, share of the training rows)
            while stack:
                v, path = stack.pop()
                f = int(feature[v])
                if f >= 0:
                    column = part[:, f]
                    left[v] = np.where(np.isnan(column), forest.missing_left[s, t, v], column <= forest.threshold[s, t, v])
                    for child, agrees in ((2 * v + 1, left[v]), (2 * v + 2, ~left[v])):
                        o, z = path.get(f, (np.ones(len(own), bool), 1.0))
                        stack.append((child, {**path, f: (o & agrees, z * cover[child] / cover[v])}))
                    continue
                at, weight = np.polynomial.legendre.leggauss((len(path) + 1) // 2)
                at, weight = (at + 1) / 2, weight / 2
                o = np.array([o for o, _ in path.values()], dtype=float)
                z = np.array([[z] for _, z in path.values()])
                for u, w in zip(at, weight):
                    factor = z * (1 - u) + o * u
                    # Products of all factors but one, from both ends: factors may be 0.
                    ahead = np.cumprod(np.vstack([np.ones((1, len(own))), factor[:-1]]), axis=0)
                    behind = np.cumprod(np.vstack([np.ones((1, len(own))), factor[:0:-1]]), axis=0)[::-1]
                    for j, f in enumerate(path):
                        out[own, f] += value[v] * w * (o[j] - z[j]) * ahead[j] * behind[j]
    return out


def expected_values(forest: Forest) -> np.ndarray:
    """Mean prediction of the training rows per group, from the leaves' covers."""
    leaf = (forest.feature < 0) & (forest.cover > 0)
    share = np.where(leaf, forest.cover, 0) / np.maximum(forest.cover[:, :, :1], 1)
    return forest.base + (share * forest.value).sum(axis=(1, 2))


def tree_shapley(df: DataFrame, model: BoostedTrees, key: str) -> DataFrame:
    """Exact Shapley values ``(key, feature, x, phi)`` of boosted trees, no background sample: per row they add up to its prediction less the mean
    prediction of its group's training rows. Rows of groups without model have NULL values. The model has to fit into ``MODEL_BYTES``."""
    if model.size() > MODEL_BYTES:
        raise ValueError("the model is too large to be sent to every task; explain groups in parts")
    arrays = df.sparkSession.sparkContext.broadcast(tuple(vars(model.forest()[1]).values()))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(slot: pd.Series, *columns: pd.Series) -> pd.Series:
        known = slot.notna().to_numpy()
        x = np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns], axis=1)
        got: list = [None] * len(slot)
        for i, row in zip(np.flatnonzero(known), forest_shapley(Forest(*arrays.value), slot[known].to_numpy(dtype="int64"), x[known])):
            got[i] = row.tolist()
        return pd.Series(got, index=slot.index, dtype=object)

    values = [F.col(c).cast("double") for c in model.features]
    rows = model.slots(df).select(key, *[v.alias(f"_x{i}") for i, v in enumerate(values)], explain("_slot", *values).alias("_phi"))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_x{i}").alias("x"), F.get("_phi", F.lit(i)).alias("phi")) for i, c in enumerate(model.features)]
    return rows.select(key, F.inline(F.array(*cells)))


def linear_shapley(df: DataFrame, coefficients: dict[str, float], key: str) -> DataFrame:
    """Exact values of a linear model: ``coef * (x - mean)``."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in coefficients])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), (F.lit(w) * (F.col(c) - F.col(f"_m_{c}"))).alias("phi")
            )
            for c, w in coefficients.items()
        ]
    )
    return attach(df, means).select(key, F.inline(cells))


def shapley_ranking(values: DataFrame, top: int = 4) -> DataFrame:
    """Features by mean absolute contribution."""
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(F.desc("mean_abs_phi"), "feature").limit(top)


def partial_dependence(
    df: DataFrame, predict: Predict, feature: str, key: str | None = None, points: int = 50, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Average prediction over all rows with the feature set to each grid value; per-row curves when ``key`` is given.

    The grid is equally spaced between two quantiles. It has ``points`` entries whatever the data size.
    """
    ends = exact_quantiles(df, feature, {"_lo": low, "_hi": high})
    g = F.sequence(F.lit(0), F.lit(points - 1))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(float(points - 1))
    spread = attach(df, ends).withColumn("point", F.explode(g)).withColumn(feature, at)
    scored = predict(spread)
    if key:
        return scored.select(key, "point", F.col(feature).alias("value"), "predicted_delta")
    return scored.groupBy("point").agg(F.first(feature).alias("value"), F.avg("predicted_delta").alias("average"))
