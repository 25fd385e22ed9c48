"""Statistics against brute force on small frames, and p-values against known values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.functions import tails
from truegauge.operators import association, binning, diagnostics, tuning


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = np.round(rng.normal(size=n), 1)
    pdf = pd.DataFrame({"k": np.arange(n), "x": x, "y": np.round(x**2 + rng.normal(size=n) * 0.5, 1), "c": 2.5, "f": rng.random(n) < 0.4})
    return pdf, spark.createDataFrame(pdf)


def dense_dcor(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(np.asarray(x)), centred(np.asarray(y))
    return math.sqrt(max((a * b).mean(), 0) / math.sqrt((a * a).mean() * (b * b).mean()))


@pytest.mark.parametrize("levels", [2, 5, 12])
def test_distance_correlation_is_exact_across_blocks(sample, levels):
    pdf, df = sample
    out = association.distance_correlation(df, "k", [("x", "y"), ("x", "c")], block_levels=levels, partitions=5)
    got = {(r["a"], r["b"]): r["dcor"] for r in out.collect()}
    assert got["x", "y"] == pytest.approx(dense_dcor(pdf.x, pdf.y), abs=1e-10)
    assert got["x", "c"] == 0.0


def test_spearman_and_mutual_information(sample):
    pdf, df = sample
    rho = association.spearman_matrix(df, ["x", "y"], "k").where("a = 'x' and b = 'y'").first()["r"]
    assert rho == pytest.approx(pdf[["x", "y"]].corr("spearman").iloc[0, 1], abs=1e-12)
    mi = {(r["a"], r["b"]): r["mi"] for r in association.mutual_information_matrix(df, ["x", "y"], 6).collect()}
    bx, by = (pd.qcut(pdf[c], 6, duplicates="drop", labels=False) for c in ("x", "y"))
    joint = pd.crosstab(bx, by).to_numpy() / len(pdf)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.nansum(joint * np.log(joint / (joint.sum(1)[:, None] * joint.sum(0)[None, :])))
    assert mi["x", "y"] == pytest.approx(want, abs=1e-12) and mi["x", "y"] == mi["y", "x"] and mi["x", "x"] == 0


def test_mann_whitney_by_pairs(sample):
    pdf, df = sample
    a, b = pdf[pdf.f].x.to_numpy(), pdf[~pdf.f].x.to_numpy()
    gt, lt = (a[:, None] > b[None, :]).sum(), (a[:, None] < b[None, :]).sum()
    got = association.mann_whitney(df, "x", "f").first()
    assert got["cliffs_delta"] == pytest.approx((gt - lt) / (len(a) * len(b)), abs=1e-12)


def test_ks_by_brute_force(sample):
    pdf, df = sample
    a, b = np.sort(pdf[pdf.f].y), np.sort(pdf[~pdf.f].y)
    at = np.unique(pdf.y)
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    roles = df.withColumn("role", F.when(F.col("f"), "a").otherwise("b"))
    assert diagnostics.two_sample_ks(roles, "y", "role", "a").first()["ks"] == pytest.approx(want, abs=1e-12)


def test_tail_values(spark):
    row = spark.range(1).select(
        tails.f_tail(F.lit(4.10282), F.lit(2.0), F.lit(10.0)).alias("f"),
        tails.t_tail(F.lit(2.228139), F.lit(10.0)).alias("t"),
        tails.chi2_tail(F.lit(18.30704), F.lit(10.0)).alias("c"),
        tails.normal_tail(F.lit(1.644854)).alias("z"),
        tails.kolmogorov_tail(F.lit(1.358099)).alias("k"),
    ).first()
    assert all(row[c] == pytest.approx(0.05, abs=2e-6) for c in "ftczk")


def test_normal_quantile_expression(spark):
    from statistics import NormalDist

    at = [1e-300, 1e-12, 1e-5, 0.01, 0.074, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in at], "p double")
    got = [r[0] for r in df.select(tails.normal_quantile(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(x) for x in at], rtol=1e-12, atol=1e-15)


def test_shapiro_wilk_published_example(spark):
    # Eleven weights of men in pounds: W = 0.79 (Shapiro and Wilk 1965), p about 0.007 (Royston).
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])], "k int, v double")
    got = diagnostics.shapiro_wilk(df, "v", ["k"]).first()
    assert got["w"] == pytest.approx(0.7888, abs=2e-3) and got["w_p"] == pytest.approx(0.0067, abs=1e-3)


def test_normality_statistic(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in rng.exponential(size=400)], "v double")
    assert diagnostics.normality(df, "v").first()["not_normal"]
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=400)], "v double")
    assert diagnostics.normality(df, "v").first()["k2_p"] > 0.001


def test_planted_defect_ranks_first(spark):
    """A prediction that leaves thickness out must be caught by the residual F test."""
    rng = np.random.default_rng(42)
    n = 500
    pdf = pd.DataFrame({"speed": rng.uniform(20, 100, n), "thickness": rng.uniform(0.3, 2, n), "grade": rng.choice(list("ABC"), n)})
    pdf["residual"] = -2 * pdf.thickness + rng.normal(0, 1, n)
    out = diagnostics.feature_tests(spark.createDataFrame(pdf), "residual", ["speed", "thickness"], ["grade"]).collect()
    assert out[0]["feature"] == "thickness" and out[0]["significant"]
    assert {r["feature"] for r in out} == {"speed", "thickness", "grade"}


def test_levene_and_anova_small(spark):
    groups = {"a": [1.0, 2, 3, 4], "b": [2.0, 4, 6, 9], "c": [5.0, 5, 6, 20], "tiny": [1.0, 2]}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")

    def f_stat(parts):
        allv = np.concatenate(parts)
        ssb = sum(len(p) * (np.mean(p) - allv.mean()) ** 2 for p in parts)
        ssw = sum(((p - np.mean(p)) ** 2).sum() for p in parts)
        return (ssb / (len(parts) - 1)) / (ssw / (len(allv) - len(parts)))

    used = [np.array(groups[g]) for g in "abc"]
    assert diagnostics.anova(df, "g", "x").first()["f"] == pytest.approx(f_stat(used))
    assert diagnostics.levene(df, "g", "x").first()["f"] == pytest.approx(f_stat([np.abs(p - np.median(p)) for p in used]))


def test_pareto_members_are_undominated(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.random((200, 2)), 1))]
    df = spark.createDataFrame(pts, "i int, a double, b double")
    got = {r["i"] for r in tuning.pareto_front(df, "a", "b").collect()}
    want = {i for i, a, b in pts if not any(p <= a and q <= b and (p < a or q < b) for _, p, q in pts)}
    assert got == want


def test_lowess_follows_a_robust_trend(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.random(400) * 10)
    y = (x - 5) ** 2 + rng.normal(size=400) * 0.3
    y[::40] += 80  # outliers the robust passes must ignore
    df = spark.createDataFrame(pd.DataFrame({"k": range(400), "x": x, "y": y}))
    curve = association.lowess(df, "x", "y", "k", robust=2)
    pdf = curve.toPandas()
    inner = pdf[(pdf.x > 1) & (pdf.x < 9)]
    assert np.abs(inner.fitted - (inner.x - 5) ** 2).max() < 3.0
    assert association.lowess_summary(curve).first()["shape"] == "U"


def test_interpolation_matches_numpy(spark):
    gx, gy = [1.0, 2.0, 4.0, 8.0], [0.0, 10.0, 0.0, 8.0]
    at = [0.0, 1.0, 1.5, 3.0, 4.0, 7.0, 9.0]
    grid = spark.createDataFrame(list(zip(gx, gy)), "gx double, gy double")
    rows = spark.createDataFrame([(x,) for x in at], "x double")
    got = binning.interpolate(rows, "x", grid, "gx", "gy", "y").toPandas().sort_values("x").y
    np.testing.assert_allclose(got, np.interp(at, gx, gy))


def test_random_candidates_stay_in_space():
    for p in tuning.random_candidates(50, 1):
        for name, _, low, high, _ in tuning.SEARCH_SPACE:
            assert low <= getattr(p, name) <= high
    assert len(tuning.parameter_grid(a=[1, 2], b=[3, 4, 5])) == len(list(itertools.product([1, 2], [3, 4, 5])))


def test_tails_at_many_degrees_of_freedom():
    """Against the limits the distributions tend to, and against plain sums where the tails are sums."""
    normal = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    t_tail = lambda t, v: tails._beta_tail(v / 2, 0.5, v / (v + t * t), t * t / (v + t * t))
    f_tail = lambda f, a, b: tails._beta_tail(b / 2, a / 2, b / (b + a * f), a * f / (b + a * f))
    for v in (1e8, 1e12):
        for z in (0.3, 2.0, 6.0):
            assert t_tail(z, v) == pytest.approx(2 * normal(z), rel=1e-5 if v < 1e9 else 1e-6)
            assert f_tail(z, 5.0, v) == pytest.approx(tails._gamma_tail(2.5, 2.5 * z), rel=1e-5 if v < 1e9 else 1e-6)
    for v in (1e8, 1e12):
        for z in (-1.5, 0.2, 3.0):
            cube = (1 + z * math.sqrt(2 / v)) ** (1 / 3)  # Wilson and Hilferty
            near = normal((cube - (1 - 2 / (9 * v))) / math.sqrt(2 / (9 * v)))
            assert tails._gamma_tail(v / 2, (v + z * math.sqrt(2 * v)) / 2) == pytest.approx(near, rel=1e-5 if v < 1e9 else 1e-6)
    poisson = math.fsum(math.exp(k * math.log(7.5) - 7.5 - math.lgamma(k + 1)) for k in range(10))
    assert tails._gamma_tail(10, 7.5) == pytest.approx(poisson, rel=1e-12)
    binomial = math.fsum(math.comb(30, k) * 0.3**k * 0.7 ** (30 - k) for k in range(12, 31))
    assert tails._beta_tail(12, 19, 0.3, 0.7) == pytest.approx(binomial, rel=1e-12)
    assert f_tail(1.01, 1e6, 1e6) == pytest.approx(normal((1.01 ** (1 / 3) - 1) * (1 - 2 / 9e6) / math.sqrt(2 / 9e6 * (1.01 ** (2 / 3) + 1))), rel=1e-3)
    assert math.isnan(tails._gamma_tail(math.nan, 1)) and tails._gamma_tail(3, 0) == 1 and tails._beta_tail(2, 3, 0, 1) == 0


def test_distance_correlation_moves_rows_once_for_all_levels(spark, monkeypatch):
    """Rows are ordered for their positions only; the levels of the cross term are worked on where the rows are."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.arange(700), "x": rng.integers(0, 90, 700).astype(float), "y": rng.normal(size=700)})
    pdf["y"] += pdf.x / 40
    calls, plain = [], association.running_totals
    monkeypatch.setattr(association, "running_totals", lambda *a, **kw: calls.append(a[1]) or plain(*a, **kw))
    got = association.distance_correlation(spark.createDataFrame(pdf), "k", [("x", "y")], block_levels=2).first()["dcor"]
    assert got == pytest.approx(dense_dcor(pdf.x, pdf.y), abs=1e-10)
    assert calls == [["feature"]]
