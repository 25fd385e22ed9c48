"""Model quality: error metrics, directional errors, comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.scalar import number
from truegauge.operators.quality import residual_outliers


def _only(cond: Column | None, x: Column) -> Column:
    return x if cond is None else F.when(cond, x)


def r2(truth: Column, pred: Column, where: Column | None = None) -> Column:
    """``1 - SSE / SST`` over rows with both values (optionally under a condition)."""
    both = truth.isNotNull() & pred.isNotNull()
    y = _only(where, F.when(both, truth))
    sse = F.sum(_only(where, (truth - pred) * (truth - pred)))
    return 1 - F.try_divide(sse, F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)))


def rmse(truth: Column, pred: Column, where: Column | None = None) -> Column:
    return F.sqrt(F.avg(_only(where, (truth - pred) * (truth - pred))))


def mae(truth: Column, pred: Column, where: Column | None = None) -> Column:
    return F.avg(_only(where, F.abs(truth - pred)))


def mape(truth: Column, pred: Column) -> Column:
    """Percent, over rows with a non-zero truth."""
    return F.avg(F.abs(F.try_divide(truth - pred, F.nullif(truth, F.lit(0.0))))) * 100


def compare_models(df: DataFrame, truth: str, predictions: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """R², RMSE, MAE and MAPE of several prediction columns in one pass."""
    long = df.select(*by, F.col(truth).alias("_y"), *[F.col(c).cast("double").alias(n) for n, c in predictions.items()]).unpivot(
        [*by, "_y"], list(predictions), "model", "_p"
    )
    y, p = F.col("_y"), F.col("_p")
    return long.groupBy(*by, "model").agg(
        F.count(F.when(y.isNotNull() & p.isNotNull(), 1)).alias("n"),
        r2(y, p).alias("r2"), rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), mape(y, p).alias("mape"),
    )


def bidirectional_table(df: DataFrame, truth: str, online: str, predictions: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """MAE of every model where the gauge reads low and where it reads high (sign of the raw residual)."""
    raw = F.col(truth) - F.col(online)
    long = df.select(*by, F.col(truth).alias("_y"), raw.alias("_raw"), *[F.col(c).alias(n) for n, c in predictions.items()]).unpivot(
        [*by, "_y", "_raw"], list(predictions), "model", "_p"
    )
    e = F.abs(F.col("_y") - F.col("_p"))
    out = long.groupBy(*by, "model").agg(
        F.count_if(F.col("_raw") > 0).alias("n_low"), F.avg(F.when(F.col("_raw") > 0, e)).alias("mae_low"),
        F.count_if(F.col("_raw") < 0).alias("n_high"), F.avg(F.when(F.col("_raw") < 0, e)).alias("mae_high"),
    )
    return out


def improvement_flags(df: DataFrame, pos: str, neg: str, raw_pos: str, raw_neg: str) -> DataFrame:
    return df.withColumns(
        {
            "both_improved": F.coalesce((F.col(pos) < F.col(raw_pos)) & (F.col(neg) < F.col(raw_neg)), F.lit(False)),
            "balance_gap": F.abs(F.col(pos) - F.col(neg)),
        }
    )


def metric_row(
    df: DataFrame, truth: str, online: str, pred: str, role: str = "role", by: Sequence[str] = (), expanding: bool = False,
    blank_empty: bool = True,
) -> DataFrame:
    """The complete metric row per group: both roles, improvements, bias, directional errors, overfit gaps.

    A directional MAE without samples is NULL, or 0 with ``blank_empty=False``.
    """
    y, o, p = F.col(truth), F.col(online), F.col(pred)
    train, test = F.col(role) == "train", F.col(role) == "test"
    raw, res = y - o, y - p
    base = {"n_train": F.count_if(train), "n_test": F.count_if(test)}
    for tag, where in (("train", train), ("test", test)):
        for name, value in (("online", o), ("model", p)):
            base[f"r2_{name}_{tag}"] = r2(y, value, where)
            base[f"rmse_{name}_{tag}"] = rmse(y, value, where)
            base[f"mae_{name}_{tag}"] = mae(y, value, where)
    for name, e in (("online", raw), ("model", res)):
        base[f"bias_{name}_test"] = F.avg(F.when(test, e))
    for side, sign in (("pos", 1), ("neg", -1)):
        base[f"{side}_count_test"] = F.count_if(test & (raw * sign > 0))
        for name, e in (("online", raw), ("model", res)):
            value = F.avg(F.when(test & (e * sign > 0), F.abs(e)))
            base[f"{side}_mae_{name}_test"] = value if blank_empty else F.coalesce(value, F.lit(0.0))
    out = df.groupBy(*by).agg(*[e.alias(n) for n, e in base.items()])
    c = F.col
    derived = {"expanding_window": F.lit(expanding)}
    for m in ("r2", "rmse", "mae"):
        derived[f"{m}_gain_train"] = c(f"{m}_model_train") - c(f"{m}_online_train")
    derived["r2_gain_test"] = c("r2_model_test") - c("r2_online_test")
    derived["rmse_gain_pct_test"] = F.coalesce(
        F.try_divide(c("rmse_online_test") - c("rmse_model_test"), F.nullif(c("rmse_online_test"), F.lit(0.0))) * 100, F.lit(0.0)
    )
    derived["mae_gain_test"] = c("mae_model_test") - c("mae_online_test")
    derived["bias_gain_test"] = c("bias_model_test") - c("bias_online_test")
    for side in ("pos", "neg"):
        derived[f"{side}_mae_gain_test"] = c(f"{side}_mae_model_test") - c(f"{side}_mae_online_test")
    derived["overfit_r2"] = c("r2_model_train") - c("r2_model_test")
    derived["overfit_mae"] = c("mae_model_train") - c("mae_model_test")
    derived["overfit_rmse"] = c("rmse_model_train") - c("rmse_model_test")
    derived["mae_ratio"] = c("mae_model_test") / (c("mae_model_train") + 1e-8)
    derived["rmse_ratio"] = c("rmse_model_test") / (c("rmse_model_train") + 1e-8)
    return out.withColumns(derived)


def residual_detail(df: DataFrame, ids: Sequence[str], truth: str, online: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-row truth, readings, residuals and the 3-sigma flag, largest residual first."""
    out = df.select(
        *ids, *[b for b in by if b not in ids], F.col(truth).alias("truth"), F.col(online).alias("online"), F.col(pred).alias("predicted"),
        (F.col(truth) - F.col(online)).alias("raw_residual"), (F.col(truth) - F.col(pred)).alias("residual"),
    ).withColumn("abs_residual", F.abs("residual"))
    return residual_outliers(out, "residual", by).orderBy(F.desc("abs_residual"), *ids)


def compare_runs(runs: dict[str, DataFrame], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric tables of several runs side by side; dirty text cells become NULL."""
    out = None
    for name, df in runs.items():
        part = df.select(*keys, *[number(m).alias(f"{m}_{name}") for m in metrics])
        out = part if out is None else out.join(part, list(keys), "full")
    return out
