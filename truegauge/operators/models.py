"""Correction models of delta: baselines, linear, Huber, boosted trees, and their smoothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.boosting import BoostedTrees, Loss, fit_boosted
from truegauge.operators.ordered import ewma
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles
from truegauge.session import materialise, shared_dir
from truegauge.spec import ModelParams

# --- weights and features --------------------------------------------------------------------------


def direction_weights(
    df: DataFrame, delta: str, damping: Column | float, pos_boost: Column | float = 1.0, by: Sequence[str] = (), out: str = "weight"
) -> DataFrame:
    """Balance the two signs of delta: ``damping`` 0 leaves all weights 1, 1 balances them fully."""
    d = damping if isinstance(damping, Column) else F.lit(float(damping))
    boost = pos_boost if isinstance(pos_boost, Column) else F.lit(float(pos_boost))
    x = F.col(delta)
    counts = df.groupBy(*by).agg(F.count_if(x > 0).alias("_pos"), F.count_if(x < 0).alias("_neg"))
    total = F.col("_pos") + F.col("_neg")
    weight = (
        F.when(d <= 0, 1.0)
        .when(x > 0, (1 - d) + d * (total / (2.0 * F.col("_pos"))) * boost)
        .when(x < 0, (1 - d) + d * (total / (2.0 * F.col("_neg"))))
        .otherwise(1.0)
    )
    return attach(df, counts, by).withColumn(out, weight).drop("_pos", "_neg")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early when a model's feature is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def missing_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as double plus one 0/1 flag each, so trees can tell an imputed value from a measured one."""
    require_columns(df, features)
    return df.withColumns({c: F.col(c).cast("double") for c in features}).withColumns(
        {f"{c}_missing": F.col(c).isNull().cast("double") for c in features}
    )


def feature_stages(features: Sequence[str], scale: bool = False) -> list:
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(
            inputCols=filled + [f"{c}_missing" for c in features], outputCol="_raw" if scale else "_features", handleInvalid="error"
        ),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True))
    return stages


# --- pluggable correction model --------------------------------------------------------------------


def huber(params: ModelParams, epsilon: float = 1.35, reg: float = 1e-4) -> LinearRegression:
    return LinearRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="predicted_delta",
        loss="huber", epsilon=epsilon, regParam=reg, elasticNetParam=0.0, maxIter=100,
    )


LEARNERS: dict[str, Callable[[ModelParams], Estimator]] = {"huber": huber}
BOOSTED = {"boosted_absolute": Loss("absolute"), "boosted_squared": Loss("squared")}


class ResidualCorrection(Estimator):
    """Fits ``label`` (delta, or truth for the direct variant) from features with direction weights.

    Boosted learners take missing values as they are, may be held monotone in some features (``monotone``, 1 or -1 by name) and fit every group of ``by`` in one
    pass, with ``settings`` (``by`` columns and any of the parameters' names) overriding the parameters of a group.
    """

    def __init__(
        self, features: Sequence[str], label: str, params: ModelParams = ModelParams(), learner: str | Callable = "boosted_absolute", by: Sequence[str] = (),
        monotone: dict[str, int] | None = None, settings: DataFrame | None = None,
    ):
        super().__init__()
        self.features, self.label, self.settings, self.learner = list(features), label, params, learner
        self.by, self.monotone, self.overrides = list(by), monotone, settings
        if learner not in BOOSTED and (by or monotone or settings is not None):
            raise ValueError("groups, monotone features and settings are for boosted learners")

    def _fit_boosted(self, dataset: DataFrame) -> ResidualCorrectionModel:
        require_columns(dataset, [*self.features, *self.by])
        rows = dataset.where(F.col(self.label).isNotNull()).select(*self.by, *self.features, F.col(self.label).cast("double").alias("_label"))
        damping, boost = self.settings.damping, self.settings.pos_boost
        given = [c for c in ("damping", "pos_boost") if self.overrides is not None and c in self.overrides.columns]
        if given:
            rows = attach(rows, self.overrides.select(*self.by, *[F.col(c).alias(f"_{c}") for c in given]), self.by)
            own = lambda c, value: F.coalesce(F.col(f"_{c}").cast("double"), F.lit(float(value))) if c in given else value
            damping, boost = own("damping", damping), own("pos_boost", boost)
        weighted = direction_weights(rows, "_label", damping, boost, self.by, "_weight")
        fitted = fit_boosted(weighted, self.features, "_label", self.by, BOOSTED[self.learner], self.settings, "_weight", self.monotone, self.overrides)
        return ResidualCorrectionModel(self.features, fitted, self.settings)

    def _fit(self, dataset: DataFrame) -> ResidualCorrectionModel:
        if self.learner in BOOSTED:
            return self._fit_boosted(dataset)
        spark = dataset.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        make = LEARNERS[self.learner] if isinstance(self.learner, str) else self.learner
        rows = missing_flags(dataset.where(F.col(self.label).isNotNull()), self.features).withColumn("_label", F.col(self.label).cast("double"))
        weighted = direction_weights(rows, "_label", self.settings.damping, self.settings.pos_boost, out="_weight")
        slim = weighted.select(*self.features, *[f"{c}_missing" for c in self.features], "_label", "_weight")
        pipeline = Pipeline(stages=[*feature_stages(self.features, scale=self.learner == "huber"), make(self.settings)])
        return ResidualCorrectionModel(self.features, pipeline.fit(slim), self.settings)


class ResidualCorrectionModel(Model):
    """Adds ``predicted_delta``; helper columns are removed again."""

    def __init__(self, features: Sequence[str], pipeline: PipelineModel | BoostedTrees, params: ModelParams):
        super().__init__()
        self.features, self.pipeline, self.settings = list(features), pipeline, params

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if isinstance(self.pipeline, BoostedTrees):
            return self.pipeline.transform(dataset)
        scored = self.pipeline.transform(missing_flags(dataset, self.features))
        return scored.select(*dataset.columns, "predicted_delta")


def smooth_and_correct(
    scored: DataFrame, online: str, order: Sequence[str], alpha: float, by: Sequence[str] = (), seed: str | None = None, idx: str | None = None
) -> DataFrame:
    """``smoothed_delta`` along the order and ``corrected = online + smoothed_delta``. ``idx`` as for :func:`ewma`."""
    out = ewma(scored, "predicted_delta", order, alpha, by, "smoothed_delta", seed, idx=idx)
    return out.withColumn("corrected", F.col(online) + F.col("smoothed_delta"))


# --- baselines and closed-form linear models ---------------------------------------------------------


def delta_baselines(df: DataFrame, delta: str, online: str, role: str, by: Sequence[str] = ()) -> DataFrame:
    """Training mean and median of delta added to the online reading."""
    train = df.where(F.col(role) == "train")
    stats = exact_quantiles(train, delta, {"_median": 0.5}, by, mean="_mean")
    return (
        attach(df, stats, by)
        .withColumns({"pred_mean": F.col(online) + F.col("_mean"), "pred_median": F.col(online) + F.col("_median")})
        .drop("_mean", "_median")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(gram: pd.Series, moment: pd.Series, ridge: pd.Series) -> pd.Series:
    """Coefficients of each row's small normal equations (rows are already aggregated)."""
    out = []
    for g, m, a in zip(gram, moment, ridge):
        d = len(m)
        left = np.asarray(g, dtype="float64").reshape(d, d) + a * np.eye(d)
        ok = np.isfinite(left).all() and np.isfinite(np.asarray(m, dtype="float64")).all()
        out.append(np.linalg.lstsq(left, np.asarray(m, dtype="float64"), rcond=None)[0].tolist() if ok else None)
    return pd.Series(out, index=gram.index)


def fit_linear(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), alpha: float = 0.0) -> DataFrame:
    """Ridge with unpenalised intercept for every group in one aggregation: ``(by..., n, intercept, coef)``.

    Only co-moments are shuffled, one row per group and task; groups may have any size.
    """
    x = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    rows = df.na.drop("any", subset=[*features, label])
    d = len(features)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("_y"),
        *[F.avg(c).alias(f"_x{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], y).alias(f"_xy{i}") for i in range(d)],
        *[F.covar_pop(x[i], x[j]).alias(f"_xx{i}_{j}") for i in range(d) for j in range(i, d)],
    )
    n = F.col("n").cast("double")
    gram = F.array(*[F.col(f"_xx{min(i, j)}_{max(i, j)}") * n for i in range(d) for j in range(d)])
    solved = agg.withColumn("coef", solve_normal(gram, F.array(*[F.col(f"_xy{i}") * n for i in range(d)]), F.lit(float(alpha))))
    dot = sum((F.col("coef")[i] * F.col(f"_x{i}") for i in range(d)), F.lit(0.0))
    return solved.select(*by, "n", (F.col("_y") - dot).alias("intercept"), "coef")


def predict_linear(df: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = (), out: str = "predicted_delta") -> DataFrame:
    dot = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(features)), F.col("intercept"))
    return attach(df, coefficients.select(*by, "intercept", "coef"), by).withColumn(out, dot).drop("intercept", "coef")


def linear_formula(coefficients: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Readable ``target = a + b * x`` per fitted row."""
    parts = [F.format_string(f"%.6f * {c}", F.col("coef")[i]) for i, c in enumerate(features)]
    return coefficients.withColumn("formula", F.concat_ws(" + ", F.format_string(f"{target} = %.6f", "intercept"), *parts))


# --- boosting with losses MLlib does not offer --------------------------------------------------------


@dataclass
class StagedTrees:
    """Sum of shallow trees whose leaf values were set for a chosen loss."""

    features: list[str]
    prepare: PipelineModel
    start: float
    step: float
    trees: list = field(default_factory=list)
    leaves: list[dict[float, float]] = field(default_factory=list)

    def add(self, df: DataFrame, score: str, which: range) -> DataFrame:
        for m in which:
            with_leaf = self.trees[m].transform(df)
            value = F.element_at(F.create_map(*[F.lit(v) for kv in self.leaves[m].items() for v in kv]), F.col("_leaf"))
            df = with_leaf.withColumn(score, F.col(score) + self.step * F.coalesce(value, F.lit(0.0))).drop("_leaf", "_p")
        return df

    def transform(self, df: DataFrame, out: str = "predicted_delta") -> DataFrame:
        ready = self.prepare.transform(missing_flags(df, self.features)).withColumn(out, F.lit(self.start))
        return self.add(ready, out, range(len(self.trees))).select(*df.columns, out)


def fit_staged(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    loss: str = "quantile",
    level: float = 0.5,
    rounds: int = 50,
    step: float = 0.1,
    depth: int = 4,
    pin_every: int = 10,
    accuracy: int = 10_000,
) -> StagedTrees:
    """Boosting for quantile or Huber loss.

    Each round fits a tree to the loss gradient, then replaces its leaf values by the optimum for the
    loss, from a mergeable quantile sketch per leaf (at most ``2**depth`` rows come back). Scores are
    written to the shared folder every few rounds, so plans stay short and a lost executor costs little.
    """
    rows = missing_flags(df.where(F.col(label).isNotNull()), features).withColumn("_y", F.col(label).cast("double"))
    prepare = Pipeline(stages=feature_stages(features)).fit(rows)
    start_at = level if loss == "quantile" else 0.5
    start = rows.agg(F.percentile_approx("_y", start_at, accuracy)).first()[0]
    model = StagedTrees(list(features), prepare, float(start), step)
    state = materialise(prepare.transform(rows).select("_features", "_y").withColumn("_f", F.lit(float(start))), "staged")
    for m in range(rounds):
        resid = F.col("_y") - F.col("_f")
        if loss == "quantile":
            current = state.withColumn("_g", F.when(resid >= 0, F.lit(level)).otherwise(F.lit(level - 1)))
        elif loss == "huber":
            width = state.agg(F.percentile_approx(F.abs(resid), 0.9, accuracy)).first()[0]
            current = state.withColumn("_g", F.greatest(F.lit(-width), F.least(F.lit(width), resid)))
        else:
            raise ValueError(f"unknown loss {loss}")
        tree = DecisionTreeRegressor(
            featuresCol="_features", labelCol="_g", predictionCol="_p", leafCol="_leaf", maxDepth=depth, seed=42
        ).fit(current.select("_features", "_g"))
        leafed = tree.transform(current)
        if loss == "quantile":
            best = leafed.groupBy("_leaf").agg(F.percentile_approx(resid, level, accuracy).alias("v"))
        else:
            med = leafed.groupBy("_leaf").agg(F.percentile_approx(resid, 0.5, accuracy).alias("_med"))
            clipped = F.greatest(F.lit(-width), F.least(F.lit(width), resid - F.col("_med")))
            best = attach(leafed, med, ["_leaf"]).groupBy("_leaf").agg((F.first("_med") + F.avg(clipped)).alias("v"))
        model.trees.append(tree)
        model.leaves.append({float(r["_leaf"]): float(r["v"]) for r in best.collect()})
        state = model.add(state, "_f", range(m, m + 1))
        if (m + 1) % pin_every == 0:
            state = materialise(state, "staged")
    return model


# --- monotone rearrangement ---------------------------------------------------------------------------


def feature_range(df: DataFrame, feature: str) -> tuple[float, float] | None:
    """(low, high) of a feature, to be kept with a model; None without values."""
    low, high = df.agg(F.min(feature).cast("double"), F.max(feature).cast("double")).first()
    return None if low is None else (low, high)


def monotone_scores(
    df: DataFrame, predict: Callable[[DataFrame], DataFrame], feature: str, key: Sequence[str], points: int = 16, decreasing: bool = True,
    span: tuple[float, float] | None = None,
) -> DataFrame:
    """Predictions forced monotone in one feature.

    Each row is scored on a fixed grid of that feature, equally spaced over ``span``, the range of the training rows (of ``df`` if it isn't
    given). The grid predictions are sorted, and the row's own value, brought into the range, is interpolated on the sorted curve. The
    grid is a set of columns of the same row: no shuffle. Rows without the feature get the plain prediction.
    """
    span = span or feature_range(df, feature)
    own, kept = f"_own_{feature}", list(df.columns)
    rows = predict(df.withColumn(own, F.col(feature).cast("double"))).select(*kept, own, F.col("predicted_delta").alias("_plain"))
    if span is None:
        return rows.select(*key, F.col(own).alias(feature), F.col("_plain").alias("predicted_delta"))
    low, high = span
    made = []
    for g in range(points):
        at = rows.withColumn(feature, F.lit(low + (high - low) * g / (points - 1)))
        made.append(f"_g{g}")
        rows = predict(at).select(*kept, own, "_plain", *made[:-1], F.col("predicted_delta").alias(made[-1]))
    curve = F.sort_array(F.array(*made), asc=not decreasing)
    width = (high - low) / (points - 1)
    inside = F.greatest(F.lit(low), F.least(F.lit(high), F.col(own)))
    pos = (inside - low) / width if width else F.lit(0.0)
    first = F.least(F.floor(pos), F.lit(points - 2)).cast("int")
    a, b = F.element_at(curve, first + 1), F.element_at(curve, first + 2)
    value = F.when(F.col(own).isNull(), F.col("_plain")).otherwise(a + (b - a) * (pos - first))
    return rows.select(*key, F.col(own).alias(feature), value.alias("predicted_delta"))
