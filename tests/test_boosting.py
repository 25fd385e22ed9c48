"""Boosted trees against a plain NumPy version, monotone probes, groups in one fit, both ways of scoring."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.operators.boosting import POINTS, Loss, best_splits, fit_boosted, ordered_values
from truegauge.spec import ModelParams

PARAMS = ModelParams(learning_rate=0.4, max_iter=2, max_depth=3)
NAMES = ["a", "b", "c"]


def data(n=900, seed=3, missing=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.5) * 1.5 + 0.2 * rng.normal(size=n)
    x[rng.random((n, 3)) < missing] = np.nan
    y += np.isnan(x[:, 1]) * 2.0
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=y, w=np.where(y > 0.3, 1.7, 0.6), k=np.arange(n), g=np.where(np.arange(n) % 4 == 0, "u", "v"))
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf.replace({np.nan: None}).astype({c: object for c in NAMES}), "a double, b double, c double, y double, w double, k long, g string")


def rank(values, p):
    return np.sort(values)[math.ceil(p * len(values)) - 1]


def quantile(r, w, level):
    """Weighted quantile of the class sketches, from their definition."""
    atoms = []
    for cls in set(np.round(np.log2(w) * 8)):
        own = np.round(np.log2(w) * 8) == cls
        atoms += [(rank(r[own], (k + 0.5) / POINTS), w[own].sum() / POINTS) for k in range(POINTS)]
    run, total = 0.0, sum(a for _, a in atoms)
    for v, a in sorted(atoms):
        run += a
        if run >= total * (level - 1e-9):
            return v


def grow(x, y, w, f, loss, params, bins, signs, least=20):
    """One tree as nested dicts, by trying every split of every node."""
    g = {"squared": f - y, "absolute": np.sign(f - y), "quantile": np.where(f >= y, 1 - loss.level, -loss.level)}[loss.kind] * w
    edges = [np.append(np.unique([rank(c[~np.isnan(c)], k / bins) for k in range(1, bins)]), np.inf) for c in x.T]  # the last parts missing values from all others

    def node(rows, level, value, low, high):
        out = {"rows": rows, "value": value}
        if level == params.max_depth:
            return out
        fit = lambda m: np.clip(-g[m].sum() / w[m].sum(), low, high)
        options = []
        for j in range(x.shape[1]):
            v = x[rows, j]
            for b, e in enumerate(edges[j]):
                for side in (0, 1) if np.isnan(v).any() else (0,):
                    left = rows[(v <= e) | (np.isnan(v) & (side == 1))]
                    right = np.setdiff1d(rows, left)
                    if min(len(left), len(right)) < least:
                        continue
                    a, c = fit(left), fit(right)
                    before, after = g[rows].sum() * fit(rows), g[left].sum() * a + g[right].sum() * c
                    gain = before - after
                    if gain > 1e-12 * (abs(before) + abs(after)) and signs[j] * (c - a) >= 0:
                        options.append((gain, -j, -b, -side, e, a, c, left, right, side == 1 if np.isnan(v).any() else len(left) > len(right)))
        if not options:
            return out
        most = max(o[0] for o in options)
        _, j, _, _, e, a, c, left, right, to_left = max(options, key=lambda o: (round(o[0] / most, 12), *o[1:4]))
        mid, j = (a + c) / 2, -j
        lo_l, hi_l, lo_r, hi_r = low, high, low, high
        if signs[j] > 0:
            hi_l = lo_r = mid
        elif signs[j] < 0:
            lo_l = hi_r = mid
        return out | {"j": j, "e": e, "to_left": to_left, "kids": (node(left, level + 1, a, lo_l, hi_l), node(right, level + 1, c, lo_r, hi_r))}

    return node(np.arange(len(y)), 0, 0.0, -np.inf, np.inf)


def settle(tree, r, w, level, signs, low=-np.inf, high=np.inf):
    """Median leaves within the bounds of constrained splits."""
    own = lambda t: quantile(r[t["rows"]], w[t["rows"]], level)
    tree["value"] = min(max(own(tree), low), high)
    if "kids" in tree:
        a, b = tree["kids"]
        bounds = [[low, high], [low, high]]
        if signs[tree["j"]]:
            mid = min(max((own(a) + own(b)) / 2, low), high)
            up, down = (1, 0) if signs[tree["j"]] > 0 else (0, 1)
            bounds[up][0] = bounds[down][1] = mid
        settle(a, r, w, level, signs, *bounds[0])
        settle(b, r, w, level, signs, *bounds[1])


def apply(tree, row):
    while "kids" in tree:
        v = row[tree["j"]]
        tree = tree["kids"][0 if (tree["to_left"] if np.isnan(v) else v <= tree["e"]) else 1]
    return tree["value"]


def twin(pdf, probe, loss, params, bins, signs):
    x, y, w = pdf[NAMES].to_numpy(float), pdf.y.to_numpy(), pdf.w.to_numpy()
    base = (w * y).sum() / w.sum() if loss.kind == "squared" else quantile(y, w, loss.level)
    f, out = np.full(len(y), base), np.full(len(probe), base)
    for _ in range(params.max_iter):
        tree = grow(x, y, w, f, loss, params, bins, signs)
        if loss.kind != "squared":
            settle(tree, y - f, w, loss.level, signs)
        f = f + params.learning_rate * np.array([apply(tree, row) for row in x])
        out = out + params.learning_rate * np.array([apply(tree, row) for row in probe[NAMES].to_numpy(float)])
    return out


@pytest.mark.parametrize("loss, monotone", [(Loss("squared"), {"a": 1}), (Loss("absolute"), {}), (Loss("absolute"), {"a": -1, "b": 1}), (Loss("quantile", 0.8), {"b": 1})])
def test_equals_the_plain_version(spark, loss, monotone):
    pdf, probe = data(), data(200, 8, 0.3)
    model = fit_boosted(frame(spark, pdf), NAMES, "y", ["g"], loss, PARAMS, "w", monotone, bins=12)
    got = model.transform(frame(spark, probe)).toPandas().sort_values("k").predicted_delta.to_numpy()
    signs = [monotone.get(c, 0) for c in NAMES]
    want = np.empty(len(probe))
    for g in "uv":
        own = (probe.g == g).to_numpy()
        want[own] = twin(pdf[pdf.g == g].reset_index(drop=True), probe[own], loss, PARAMS, 12, signs)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kind", ["squared", "absolute"])
def test_monotone_on_a_dense_probe(spark, kind):
    pdf = data(2500, 5)
    model = fit_boosted(frame(spark, pdf), NAMES, "y", (), Loss(kind), ModelParams(learning_rate=0.3, max_iter=3, max_depth=4), monotone={"a": 1, "b": -1})
    _, forest = model.forest()
    rng = np.random.default_rng(0)
    for j, sign in ((0, 1), (1, -1)):
        for row in rng.normal(size=(40, 3)):
            x = np.tile(row, (400, 1))
            x[:, j] = np.linspace(-4, 4, 400)
            assert (sign * np.diff(forest.scores(np.zeros(400, int), x)) >= -1e-12).all()


def test_groups_in_one_fit_equal_single_fits(spark):
    pdf = data(1000, 6).assign(g=lambda d: np.where(d.k < 330, "hot", np.where(d.k % 9 == 0, None, (d.k % 7).astype(str))))
    df = frame(spark, pdf)
    settings = spark.createDataFrame([("hot", 1, 2, 0.9), ("1", None, 1, None)], "g string, max_iter int, max_depth int, learning_rate double")
    model = fit_boosted(df, NAMES, "y", ["g"], Loss("absolute"), PARAMS, "w", settings=settings, bins=20)
    both = model.transform(df, "p").collect()
    joined = {r.k: r.p for r in model.transform(df, "p", most=0).collect()}
    assert all(joined[r.k] == pytest.approx(r.p, abs=1e-12) for r in both) and len(both) == 1000
    for g, params in (("hot", ModelParams(learning_rate=0.9, max_iter=1, max_depth=2)), ("1", ModelParams(learning_rate=0.4, max_iter=2, max_depth=1)), ("3", PARAMS), (None, PARAMS)):
        one = df.where(F.col("g").eqNullSafe(g))
        alone = fit_boosted(one, NAMES, "y", (), Loss("absolute"), params, "w", bins=20).transform(one, "p").collect()
        want = {r.k: r.p for r in alone}
        got = {r.k: r.p for r in both if r.g == g}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in got) < 1e-9
    new = df.limit(3).withColumn("g", F.lit("unseen"))
    assert [r.p for r in model.transform(new, "p").collect()] == [None] * 3 == [r.p for r in model.transform(new, "p", most=0).collect()]


def test_jobs_do_not_grow_with_groups(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"groups-{n}", "")
        rows = spark.range(4000).select((F.col("id") % n).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("y"))
        model = fit_boosted(rows, ["a"], "y", ["g"], Loss("squared"), ModelParams(max_iter=2, max_depth=2), least_rows=2)
        assert model.base.count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-{n}"))

    assert jobs(1000) <= jobs(1) + 4
    spark.sparkContext.setJobGroup("", "")


def test_edges(spark):
    df = frame(spark, data(60, 2))
    none = fit_boosted(df.where("false"), NAMES, "y", ["g"], Loss(), PARAMS)
    assert [r.predicted_delta for r in none.transform(df.limit(2)).collect()] == [None, None]
    few = fit_boosted(df.limit(15), NAMES, "y", (), Loss("squared"), PARAMS)  # fewer than two leaves' rows
    mean = df.limit(15).agg(F.avg("y")).first()[0]
    assert few.transform(df).where(F.abs(F.col("predicted_delta") - mean) > 1e-9).count() == 0
    blank = df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(float("nan"))).withColumn("c", F.lit(1.0))
    flat = fit_boosted(blank, NAMES, "y", (), Loss("absolute"), PARAMS)
    assert flat.transform(blank).select("predicted_delta").distinct().count() == 1
    odd = df.withColumn("y", F.when(F.col("k") > 3, F.col("y"))).withColumn("w", F.when(F.col("k") > 5, 1.0).otherwise(0.0))
    assert fit_boosted(odd, NAMES, "y", (), Loss(), PARAMS, "w").base.first()[0] is not None
    with pytest.raises(ValueError, match="missing feature"):
        few.transform(df.drop("a"))


def test_ordered_values_and_missing_side():
    assert ordered_values(np.array([0.0, 3.0, 1.0]), np.array([0, -1, -1]), [1]).tolist() == [0.0, 2.0, 2.0]
    assert ordered_values(np.array([0.0, 3.0, 1.0]), np.array([0, -1, -1]), [0]).tolist() == [0.0, 3.0, 1.0]
    g = np.array([[[6.0, 2.0, -8.0]]])  # missing, bin 0, bin 1
    n = np.array([[[3.0, 2.0, 5.0]]])
    found = best_splits(g, n, n, np.array([-np.inf]), np.array([np.inf]), [0], least_rows=1)
    assert found[0][0] and found[3][0] and found[6][0] == 5  # the missing rows go with bin 0
