"""Residual diagnostics."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.exact import KS_ROWS, ks_exact
from truegauge.functions.tails import chi2_tail, f_tail, kolmogorov_tail, normal_quantile, normal_tail, polynomial, t_tail
from truegauge.operators.binning import quantile_bins
from truegauge.operators.ordered import lagged
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import exact_quantiles, value_positions
from truegauge.operators.splits import numbered
from truegauge.session import materialise


def autocorrelation(df: DataFrame, value: str, order: Sequence[str], lags: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., lag, acf)`` for lags 1..k, normalised by the full sum of squares."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    centred = attach(rows, rows.groupBy(*by).agg(F.avg(value).alias("_m")), by).withColumn("_x", F.col(value) - F.col("_m"))
    shifted = lagged(centred.select(*by, *order, "_x"), "_x", lags, order, by)
    sums = shifted.groupBy(*by).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_ss"),
        *[F.sum(F.col("_x") * F.col(f"lag_{k}")).alias(f"{k}") for k in range(1, lags + 1)],
    )
    long = sums.unpivot([*by, "_ss"], [str(k) for k in range(1, lags + 1)], "lag", "_s")
    return long.select(*by, F.col("lag").cast("int").alias("lag"), F.try_divide(F.col("_s"), F.col("_ss")).alias("acf"))


# --- normality -----------------------------------------------------------------------------------


def normality(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, MAE, population skew, excess kurtosis and D'Agostino's K² with its p-value."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.avg(F.abs(F.col(value))).alias("mae"),
        F.skewness(value).alias("skew"),
        F.kurtosis(value).alias("kurtosis"),
    )
    n, g1, b2 = F.col("n").cast("double"), F.col("skew"), F.col("kurtosis") + 3
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.asinh(ratio) / F.sqrt(0.5 * F.log(w2))

    centre = 3 * (n - 1) / (n + 1)
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    x = (b2 - centre) / spread
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    z_kurt = (1 - 2 / (9 * a) - F.signum(denom) * F.cbrt((1 - 2 / a) / F.abs(denom))) / F.sqrt(2 / (9 * a))

    k2 = F.when(F.col("n") >= 8, z_skew * z_skew + z_kurt * z_kurt)
    return base.withColumn("k2", k2).withColumn("k2_p", F.exp(-F.col("k2") / 2)).withColumn("not_normal", F.col("k2_p") < 0.05)


# Royston's polynomial coefficients for the Shapiro-Wilk weights and p-value (fixed values).
SW_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_DEV = (-0.4803, -0.082676, 0.0030302)
SW_MEAN_SMALL = (0.544, -0.39978, 0.025054, -0.0006714)
SW_DEV_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)


def shapiro_wilk(df: DataFrame, value: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """W and p of every group of three rows or more; NULL for smaller and for constant groups.

    ``p_in_range`` tells whether the group has at most 5,000 rows, for which the approximation of p was published.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = attach(df.where(F.col(value).isNotNull()), sizes, by).where(F.col("n") >= 3).drop("n")
    placed = numbered(rows.select(*by, *tie, value), [value, *tie], by)
    n, i = F.col("_n").cast("double"), F.col("_i").cast("double") + 1
    scored = placed.withColumn("_m", normal_quantile((i - 0.375) / (n + 0.25)))
    last, prev = F.col("_i") == F.col("_n") - 1, F.col("_i") == F.col("_n") - 2
    inner = (F.col("_i") > 1) & (F.col("_i") < F.col("_n") - 2)
    x, m = F.col(value).cast("double"), F.col("_m")
    agg = scored.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.sum(m * m).alias("mm"),
        F.max(F.when(last, m)).alias("m_last"),
        F.max(F.when(prev, m)).alias("m_prev"),
        F.max(F.when(last, x)).alias("x_last"),
        F.max(F.when(prev, x)).alias("x_prev"),
        F.max(F.when(F.col("_i") == 0, x)).alias("x_first"),
        F.max(F.when(F.col("_i") == 1, x)).alias("x_second"),
        F.sum(F.when(inner, m * x)).alias("mx"),
        (F.var_pop(x) * F.count(x)).alias("ss"),
    )
    nn = F.col("n").cast("double")
    u = 1 / F.sqrt(nn)
    root = F.nullif(F.sqrt("mm"), F.lit(0.0))
    a1, a2 = polynomial(SW_LAST, u) + F.col("m_last") / root, polynomial(SW_NEXT, u) + F.col("m_prev") / root
    ml, mp = F.col("m_last"), F.col("m_prev")
    # From six rows on the two outer weights are approximated, up to five only the outermost; with three it is exact.
    a1 = F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(a1)
    wide = (F.col("mm") - 2 * ml * ml - 2 * mp * mp) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    narrow = (F.col("mm") - 2 * ml * ml) / (1 - 2 * a1 * a1)
    ends, mx = a1 * (F.col("x_last") - F.col("x_first")), F.coalesce(F.col("mx"), F.lit(0.0))
    next_ = F.col("x_prev") - F.col("x_second")
    fit = F.when(F.col("n") == 3, ends).when(F.col("n") <= 5, ends + (F.coalesce(mp * next_, F.lit(0.0)) + mx) / F.sqrt(narrow)).otherwise(
        ends + a2 * next_ + mx / F.sqrt(wide)
    )
    w = F.when(F.col("ss") > 0, F.least(F.try_divide(fit * fit, F.col("ss")), F.lit(1.0)))
    ln = F.log(nn)
    z_large = (F.log(1 - F.col("w")) - polynomial(SW_MEAN, ln)) / F.exp(polynomial(SW_DEV, ln))
    small = -F.log(F.lit(-2.273) + 0.459 * nn - F.log(1 - F.col("w")))
    z_small = (small - polynomial(SW_MEAN_SMALL, nn)) / F.exp(polynomial(SW_DEV_SMALL, nn))
    exact = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    p = F.when(F.col("n") == 3, exact).otherwise(normal_tail(F.when(F.col("w") < 1, F.when(F.col("n") > 11, z_large).otherwise(z_small))))
    tested = agg.withColumn("w", w).select(*by, "w", F.when(F.col("w") >= 1, 1.0).otherwise(p).alias("w_p"))
    return attach(sizes, tested, by).withColumn("p_in_range", F.col("n") <= 5000)


# --- variance analysis ---------------------------------------------------------------------------


def anova(df: DataFrame, group: str, value: str, by: Sequence[str] = (), min_per_group: int = 3) -> DataFrame:
    """One-way F over the groups with enough rows; needs two of them. Only group sums are shuffled."""
    per = (
        df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
        .groupBy(*by, group)
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("_within"))
        .where(F.col("_n") >= min_per_group)
    )
    w = F.col("_n")
    tot = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("_n").alias("n"),
        F.sum("_within").alias("_ssw"),
        (F.sum(w * F.col("_mean")) / F.sum(w)).alias("_grand"),
    )
    between = (
        attach(per, tot.select(*by, "_grand"), by)
        .groupBy(*by)
        .agg(F.sum(w * F.pow(F.col("_mean") - F.col("_grand"), 2)).alias("_ssb"))
    )
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when(d1 >= 1, F.try_divide(F.col("_ssb") / d1, F.nullif(F.col("_ssw") / d2, F.lit(0.0))))
    return attach(tot, between, by).select(*by, "groups", "n", f.alias("f"), d1.alias("df_between"), d2.alias("df_within"))


def with_f_p(df: DataFrame, f: str = "f") -> DataFrame:
    p = f_tail(F.col(f), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return df.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def levene(df: DataFrame, group: str, value: str, by: Sequence[str] = (), min_per_group: int = 3) -> DataFrame:
    """Brown-Forsythe form: one-way F of the absolute deviations from the group medians."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(*by, group, value)
    med = exact_quantiles(rows, value, {"_med": 0.5}, [*by, group])
    dev = attach(rows, med, [*by, group]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return anova(dev, group, "_dev", by, min_per_group)


def heteroscedasticity(df: DataFrame, prediction: str, residual: str, bins: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Levene's test over equal-frequency bins of the prediction."""
    rows = materialise(df.select(*by, prediction, residual), "residuals")
    return levene(materialise(quantile_bins(rows, prediction, bins, by).select(*by, "bin", residual), "binned"), "bin", residual, by)


def feature_tests(
    df: DataFrame, residual: str, numeric: Sequence[str], categorical: Sequence[str], bins: int = 8
) -> DataFrame:
    """F test of the residual over bins (numeric) or categories of every feature, most significant first."""
    parts = []
    df = materialise(df.select(residual, *[c for c in dict.fromkeys([*numeric, *categorical]) if c != residual]), "features")
    if numeric:
        long = df.select(F.col(residual).alias("_r"), *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            ["_r"], list(numeric), "feature", "_x"
        )
        long = long.where(F.col("_x").isNotNull() & F.col("_r").isNotNull())
        tested = anova(quantile_bins(long, "_x", bins, ["feature"], "_g"), "_g", "_r", ["feature"])
        parts.append(tested.where(F.col("n") >= bins * 3).withColumn("kind", F.lit("numeric")))
    if categorical:
        long = df.select(F.col(residual).alias("_r"), *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            ["_r"], list(categorical), "feature", "_g"
        )
        parts.append(anova(long, "_g", "_r", ["feature"]).where(F.col("n") >= 10).withColumn("kind", F.lit("categorical")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_f_p(both).orderBy(F.asc_nulls_last("p_value"), "feature")


def overfit_ratio(df: DataFrame, residual: str, role: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.abs(F.col(residual))
    test, train = F.avg(F.when(F.col(role) == "test", e)), F.avg(F.when(F.col(role) == "train", e))
    return df.groupBy(*by).agg(
        train.alias("mae_train"), test.alias("mae_test"), (test / F.greatest(train, F.lit(1e-6))).alias("overfit_ratio")
    )


# --- time dependence -----------------------------------------------------------------------------


def ljung_box(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), max_lag: int = 10) -> DataFrame:
    """Q over lags 1..min(max_lag, n // 3) with its chi-square p-value."""
    acf = autocorrelation(df, value, order, max_lag, by)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n, k = F.col("n"), F.col("lag")
    used = attach(acf, sizes, by).where(k <= F.least(F.lit(max_lag), F.floor(n / 3)))
    return (
        used.groupBy(*by)
        .agg(
            F.max("n").alias("n"),
            F.count(F.lit(1)).alias("lags"),
            (F.max(n * (n + 2)) * F.sum(F.col("acf") * F.col("acf") / (n - k))).alias("q"),
        )
        .withColumn("p_value", chi2_tail(F.col("q"), F.col("lags").cast("double")))
    )


# --- distribution comparison ----------------------------------------------------------------------


def two_sample_ks(df: DataFrame, value: str, role: str, first: str, by: Sequence[str] = (), min_rows: int = 10, exact: bool = False) -> DataFrame:
    """Largest gap of the two empirical distribution functions, on counts of distinct values.

    ``ks_p`` is the limit distribution's, or with ``exact`` the exact law's where neither sample has more than ``KS_ROWS`` rows. Both take the
    values as distinct; with ties they are on the safe side.
    """
    at = value_positions(df.withColumn("_f", (F.col(role) == first).cast("long")), value, by, {"a": F.col("_f")})
    na, nb = F.col("cum_a_all"), F.col("upto_all") - F.col("cum_a_all")
    gap = F.abs(F.try_divide(F.col("cum_a"), na) - F.try_divide(F.col("upto") - F.col("cum_a"), nb))
    out = at.groupBy(*by).agg(F.max(na).alias("n_first"), F.max(nb).alias("n_second"), F.max(gap).alias("ks"))
    enough = (F.col("n_first") >= min_rows) & (F.col("n_second") >= min_rows)
    n1, n2 = F.col("n_first"), F.col("n_second")
    out = out.withColumn("ks", F.when(enough, F.col("ks")))
    limit = F.when(enough, kolmogorov_tail(F.col("ks") * F.sqrt(n1 * n2 / (n1 + n2))))
    if not exact:
        return out.withColumn("ks_p", limit)
    out = out.withColumns({"_limit": limit, "_law": ks_exact(n1, n2, F.col("ks"))})
    return out.withColumn("ks_p", F.when(F.greatest(n1, n2) <= KS_ROWS, F.col("_law")).otherwise(F.col("_limit"))).drop("_limit", "_law")


def drift(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), head: float = 0.8, min_rows: int = 30, exact: bool = False
) -> DataFrame:
    """First share against the rest in time order: KS (``exact`` as in :func:`two_sample_ks`), mean difference, population deviation ratio, verdict."""
    placed = materialise(numbered(df.select(*by, *order, value), order, by), "drift")
    late = F.col("_i") >= F.floor(F.col("_n") * F.lit(head))
    rows = placed.where(F.col("_n") >= min_rows).withColumn("role", F.when(late, "late").otherwise("early"))
    x, a, b = F.col(value), F.col("role") == "early", F.col("role") == "late"
    stats = rows.groupBy(*by).agg(
        F.max("_n").alias("rows"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.avg(F.when(a, x)).alias("mean_early"),
        F.avg(F.when(b, x)).alias("mean_late"),
        (F.avg(F.when(b, x)) - F.avg(F.when(a, x))).alias("mean_diff"),
        (F.stddev_pop(F.when(b, x)) / (F.stddev_pop(F.when(a, x)) + 1e-8)).alias("std_ratio"),
    )
    ks = two_sample_ks(rows, value, "role", "early", by, exact=exact).select(*by, "ks", "ks_p")
    verdict = (
        F.when((F.col("ks_p") < 0.01) & (F.abs("mean_diff") > 0.05), "clear drift")
        .when(F.col("ks_p") < 0.05, "suspicious drift")
        .otherwise("stable")
    )
    return attach(stats, ks, by).withColumn("verdict", verdict)


def compare_roles(df: DataFrame, columns: Sequence[str], role: str, first: str, exact: bool = False) -> DataFrame:
    """KS between two roles for several features at once."""
    long = df.select(role, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([role], list(columns), "feature", "_x")
    return two_sample_ks(long, "_x", role, first, ["feature"], exact=exact)


def mean_tests(df: DataFrame, value: str, by: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """One-sample t test of mean zero per group."""
    agg = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    t = F.try_divide(F.col("mean"), F.nullif(F.col("std") / F.sqrt("n"), F.lit(0.0)))
    return (
        agg.where(F.col("n") >= min_rows)
        .withColumn("t", t)
        .withColumn("p_value", t_tail(F.col("t"), (F.col("n") - 1).cast("double")))
        .withColumn("significant", F.col("p_value") < 0.05)
    )
