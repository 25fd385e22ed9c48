"""Model properties: weights, baselines beaten, monotone output, Shapley efficiency, stored models, streams."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.operators import boosting, interpret, models, quality
from truegauge.plans import calibrate
from truegauge.sources import sinks
from truegauge.spec import ModelParams
from truegauge.streaming import queries as streams

QUICK = ModelParams(damping=0.3, alpha_smoothing=0.9, learning_rate=0.2, max_iter=8, max_depth=3)
ROLES = calibrate.TrainingRoles("truth", "online", "delta", ("online", "speed"), ("t",), ("g",))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 1200
    online, speed = rng.uniform(1, 5, n), rng.uniform(20, 100, n)
    delta = -0.4 * online + 0.01 * speed + rng.normal(0, 0.05, n)
    pdf = pd.DataFrame({"t": range(n), "g": np.where(np.arange(n) % 3 == 0, "a", "b"), "grade": np.where(online > 3, "X", "Y"),
                        "online": online, "speed": speed, "delta": delta, "truth": online + delta})
    pdf.loc[5, "speed"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("speed", F.nanvl("speed", F.lit(None).cast("double")))
    return df.withColumn("role", F.when(F.col("t") < 960, "train").otherwise("test")).cache()


def mae(df, col):
    return df.where("role = 'test'").agg(F.avg(F.abs(F.col("truth") - F.col(col)))).first()[0]


def test_weights_balance_signs(rows):
    w = models.direction_weights(rows, "delta", 1.0)
    by_sign = w.groupBy(F.signum("delta").alias("s")).agg(F.sum("weight").alias("w")).collect()
    total = [r["w"] for r in by_sign]
    assert len(total) == 2 and total[0] == pytest.approx(total[1])
    assert models.direction_weights(rows, "delta", 0.0).where("weight <> 1").count() == 0


@pytest.mark.parametrize("learner", ["boosted_absolute", "boosted_squared", "huber"])
def test_models_beat_the_mean_baseline(rows, learner):
    _, scored = calibrate.train_and_score(rows, ROLES, QUICK, learner)
    base = models.delta_baselines(rows, "delta", "online", "role")
    assert mae(scored, "corrected") < mae(base, "pred_mean")


def test_linear_fit_recovers_coefficients(rows):
    fit = models.fit_linear(rows, ["online", "speed"], "delta").first()
    assert fit["coef"] == pytest.approx([-0.4, 0.01], abs=0.01)
    text = models.linear_formula(models.fit_linear(rows, ["online"], "delta"), ["online"], "delta").first()["formula"]
    assert text.startswith("delta = ") and "* online" in text


def test_quantile_boosting_covers_its_level(rows):
    model = models.fit_staged(rows, ["online", "speed"], "delta", "quantile", 0.8, rounds=6, step=0.4, depth=3)
    share = model.transform(rows).agg(F.avg((F.col("delta") <= F.col("predicted_delta")).cast("double"))).first()[0]
    assert 0.7 < share < 0.9


def test_constrained_scores_decrease(rows):
    model = models.ResidualCorrection(["online", "speed"], "delta", QUICK, monotone={"online": -1}).fit(rows)
    fixed = rows.where("t < 60").withColumn("speed", F.lit(50.0))
    got = model.transform(fixed).toPandas().sort_values("online")
    assert (np.diff(got.predicted_delta) <= 1e-12).all()


def test_group_settings_and_weights(spark, rows):
    settings = spark.createDataFrame([("a", 1.0, 1)], "g string, damping double, max_iter int")
    both = models.ResidualCorrection(["online"], "delta", QUICK, "boosted_absolute", ["g"], settings=settings).fit(rows).transform(rows)
    one = models.ResidualCorrection(["online"], "delta", replace(QUICK, damping=1.0, max_iter=1)).fit(rows.where("g = 'a'")).transform(rows.where("g = 'a'"))
    pair = both.select("t", "predicted_delta").join(one.select("t", F.col("predicted_delta").alias("p")), "t").toPandas()
    assert len(pair) == 400 and np.abs(pair.predicted_delta - pair.p).max() < 1e-9
    with pytest.raises(ValueError, match="boosted learners"):
        models.ResidualCorrection(["online"], "delta", QUICK, "huber", ["g"])


def subset_value(forest, x, known):
    """Prediction with only some features known: unknown splits are averaged by cover."""

    def walk(t, v):
        f = forest.feature[0, t, v]
        if f < 0:
            return forest.value[0, t, v]
        if f in known:
            left = forest.missing_left[0, t, v] if np.isnan(x[f]) else x[f] <= forest.threshold[0, t, v]
            return walk(t, 2 * v + 1 if left else 2 * v + 2)
        c = forest.cover[0, t]
        return (c[2 * v + 1] * walk(t, 2 * v + 1) + c[2 * v + 2] * walk(t, 2 * v + 2)) / c[v]

    return forest.base[0] + sum(walk(t, 0) for t in range(forest.feature.shape[1]))


def test_tree_shapley_equals_all_subsets(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 4))
    x[rng.random((700, 4)) < 0.1] = np.nan
    clean = np.nan_to_num(x)
    y = clean[:, 0] * clean[:, 1] + (clean[:, 2] > 0) * clean[:, 0] + clean[:, 3]
    names = ["p", "q", "r", "s"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).replace({np.nan: None}).astype(object).assign(y=y, k=range(700)), "p double, q double, r double, s double, y double, k long")
    model = boosting.fit_boosted(df, names, "y", (), boosting.Loss("squared"), ModelParams(learning_rate=0.5, max_iter=4, max_depth=4))
    _, forest = model.forest()
    got = interpret.forest_shapley(forest, np.zeros(25, int), x[:25])
    for row, phi in zip(x[:25], got):
        for j in range(4):
            others = [i for i in range(4) if i != j]
            want = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    want += math.factorial(size) * math.factorial(3 - size) / 24 * (subset_value(forest, row, {*s, j}) - subset_value(forest, row, set(s)))
            assert phi[j] == pytest.approx(want, abs=1e-9)
    out = interpret.tree_shapley(df, model, "k").groupBy("k").agg(F.sum("phi").alias("total")).join(model.transform(df), "k").toPandas()
    mean = out.predicted_delta.mean()
    assert interpret.expected_values(forest)[0] == pytest.approx(mean, abs=1e-9)
    assert len(out) == 700 and np.abs(out.predicted_delta - mean - out.total).max() < 1e-9
    unseen = boosting.fit_boosted(df.withColumn("g", F.lit("a")), names, "y", ["g"], boosting.Loss("squared"), ModelParams(max_iter=1, max_depth=1))
    assert [r.phi for r in interpret.tree_shapley(df.limit(1).withColumn("g", F.lit("b")), unseen, "k").collect()] == [None] * 4


def test_sampled_shapley_draws_from_all_rows(rows):
    """Of a sum of features, each contribution is its value less that of the rows drawn: over many rows the mean of all."""

    def f(df):
        return df.withColumn("predicted_delta", F.col("online") + F.col("speed"))

    full = rows.na.drop()
    phi = interpret.shapley_values(full, f, ["online", "speed"], "t", permutations=4)
    got = phi.groupBy("feature").agg(F.avg("phi").alias("m"), F.countDistinct(F.round(F.col("x") - F.col("phi"), 6)).alias("n")).toPandas().set_index("feature")
    assert abs(got.loc["online", "m"]) < 0.15 and (got.n > 1000).all()


def test_shapley_adds_up_for_every_row(rows):
    def f(df):
        return df.withColumn("predicted_delta", F.col("online") * F.col("speed") + 1)

    few = rows.where("speed is not null and t < 50")
    phi = interpret.shapley_values(few, f, ["online", "speed"], "t", permutations=4, background=1)
    got = phi.groupBy("t").agg(F.sum("phi").alias("s")).toPandas().set_index("t").s.sort_index()
    value = f(few).select("t", "predicted_delta").toPandas().set_index("t").predicted_delta.sort_index()
    assert (value - got).std() < 1e-9  # the constant left over is the background row's own prediction


def test_importance_finds_the_only_used_feature(rows):
    def f(df):
        return df.withColumn("predicted_delta", -0.4 * F.col("online"))

    got = interpret.permutation_importance(rows.na.drop(), f, ["online", "speed"], "delta", "t", repeats=2).collect()
    assert got[0]["feature"] == "online" and got[0]["importance"] > 0.1 and got[1]["importance"] == pytest.approx(0)


def test_store_score_and_missing_feature(spark, rows, tmp_path):
    path = str(tmp_path / "model")
    roles = calibrate.TrainingRoles("truth", "online", "delta", ("online", "speed", "grade_encoded"), ("t",), ("g",))
    calibrate.train_and_save(rows.where("role = 'train'"), roles, QUICK, "grade", path, "huber")
    new = rows.where("role = 'test'").drop("truth", "delta")
    cold = calibrate.score_batch(new, path, alpha=0.5)
    warm = calibrate.score_batch(new, path, warm_start=True, alpha=0.5)
    both = cold.select("t", "g", "smoothed_delta").join(warm.select("t", F.col("smoothed_delta").alias("w")), "t").toPandas().sort_values("t")
    assert len(both) == 240
    first = both.groupby("g").head(1)
    assert (np.abs(first.smoothed_delta - first.w) > 1e-9).all() and np.abs(both.smoothed_delta - both.w).tail(50).max() < 1e-9
    with pytest.raises(ValueError, match="missing feature columns"):
        calibrate.score_batch(new.drop("speed"), path)
    with pytest.raises(FileNotFoundError):
        calibrate.score_batch(new, path + "-none")


def test_a_failed_write_leaves_the_last_version(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    roles = calibrate.TrainingRoles("truth", "online", "delta", ("online", "speed", "grade_encoded"), ("t",), ("g",))
    params = replace(QUICK, max_iter=2, max_depth=2)
    assert calibrate.train_and_save(rows.where("role = 'train'"), roles, params, "grade", path, model_by=["g"], monotone={"online": -1}) == 1
    new = rows.where("role = 'test'").drop("truth", "delta")
    want = sorted((r.t, r.corrected) for r in calibrate.score_batch(new, path, warm_start=True).collect())
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            calibrate.score_batch(new, path, warm_start=True, save_state=True)
    assert sinks.versions(spark, path) == [1]
    assert sorted((r.t, r.corrected) for r in calibrate.score_batch(new, path, warm_start=True, save_state=True).collect()) == want
    assert sinks.versions(spark, path) == [1, 2]
    state = {v: {r.g: r.last_smoothed for r in sinks.load_artefact(spark, path, v).state.collect()} for v in (1, 2)}
    assert set(state[1]) == set(state[2]) == {"a", "b"} and state[1] != state[2]
    assert sorted((r.t, r.corrected) for r in calibrate.score_batch(new, path, warm_start=True, version=1).collect()) == want
    old = sinks.load_artefact(spark, path, 1)
    with pytest.raises(FileExistsError):  # somebody else went on from version 1 meanwhile
        sinks.save_state(path, old, old.state)


def test_saved_state_of_a_null_group(spark, rows, tmp_path):
    """One state row per group after every batch, NULL included; no row comes back twice."""
    path = str(tmp_path / "model")
    roles = calibrate.TrainingRoles("truth", "online", "delta", ("online", "speed", "grade_encoded"), ("t",), ("g", "line"))
    rows = rows.withColumn("g", F.when(F.col("g") != rows.agg(F.min("g")).first()[0], F.col("g"))).withColumn("line", F.lit(None).cast("string"))
    calibrate.train_and_save(rows.where("role = 'train'"), roles, QUICK, "grade", path, "huber")
    groups = rows.select("g").distinct().count()
    new = rows.where("role = 'test'").drop("truth", "delta")
    for k in range(4):
        batch = new.where(F.col("t") % 4 == k)
        out = calibrate.score_batch(batch, path, warm_start=True, save_state=True, alpha=0.5)
        assert out.count() == batch.count()
        state = sinks.load_artefact(spark, path).state
        assert state.count() == state.select("g").distinct().count() == groups and state.where("g is null").count() == 1


def test_expanding_evaluation_reports_every_fold(rows):
    roles = calibrate.TrainingRoles("truth", "online", "delta", ("online", "speed"), ("t",))
    out = calibrate.expanding_evaluation(rows.drop("role"), roles, QUICK).collect()
    assert [r["fold"] for r in out] == [1, 2, 3] and all(r["n_train"] >= 30 for r in out)


def test_clean_and_rejected_partition_the_input(rows):
    flagged = quality.residual_outliers(rows, "delta", ["g"], 1.0)
    assert flagged.count() == rows.count()
    assert flagged.where("is_outlier is null").count() == 0


def test_restart_stream_counts_the_last_value_once(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(30)], "g string, t long, v double")
    src, out, state, chk = (str(tmp_path / n) for n in ("in", "out", "state", "chk"))
    handler = streams.smoothing_batches("v", ["t"], ["g"], 0.3, out, state, restart=True)
    want, seed = [], None
    for lo in (0, 10, 20):
        df.where((F.col("t") >= lo) & (F.col("t") < lo + 10)).write.mode("append").parquet(src)
        stream = streams.file_stream(spark, src, df.schema)
        streams.run_batches(stream, handler, chk)
        s = pd.Series(([seed] if seed is not None else []) + [float(i % 5) for i in range(lo, lo + 10)]).ewm(alpha=0.3).mean()
        part = s.tolist()[-10:]
        want, seed = want + part, part[-1]
    got = spark.read.parquet(out).toPandas().sort_values("t").smoothed
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_null_group_keeps_one_state(spark, tmp_path):
    df = spark.createDataFrame([(None if t % 3 else "a" if t < 10 or t >= 20 else "b", t, float(t * t % 7)) for t in range(40)], "g string, t long, v double")
    src, out, state, chk = (str(tmp_path / n) for n in ("in", "out", "state", "chk"))
    handler = streams.smoothing_batches("v", ["t"], ["g"], 0.4, out, state)
    for k, lo in enumerate((0, 10, 20, 30)):
        df.where((F.col("t") >= lo) & (F.col("t") < lo + 10)).write.mode("append").parquet(src)
        streams.run_batches(streams.file_stream(spark, src, df.schema), handler, chk)
        kept = spark.read.parquet(f"{state}/batch={k}")
        assert kept.count() == kept.select("g").distinct().count() and kept.where("g is null").count() == 1
    got = spark.read.parquet(out).toPandas().sort_values("t")
    pdf = df.toPandas().sort_values("t")
    want = pdf.groupby("g", dropna=False).v.transform(lambda s: s.ewm(alpha=0.4).mean())
    assert got.t.tolist() == list(range(40))
    np.testing.assert_allclose(got.smoothed.to_numpy(), want, atol=1e-12)


def test_late_groups_keep_their_state(spark, tmp_path):
    df = spark.createDataFrame([("a" if t < 10 or t >= 20 else "b", t, float(t)) for t in range(30)], "g string, t long, v double")
    src, out, state, chk = (str(tmp_path / n) for n in ("in", "out", "state", "chk"))
    handler = streams.smoothing_batches("v", ["t"], ["g"], 0.4, out, state)
    for lo in (0, 10, 20):
        df.where((F.col("t") >= lo) & (F.col("t") < lo + 10)).write.mode("append").parquet(src)
        streams.run_batches(streams.file_stream(spark, src, df.schema), handler, chk)
    got = spark.read.parquet(out).toPandas().sort_values("t").smoothed.to_numpy()
    pdf = df.toPandas().sort_values("t")
    want = pdf.groupby("g").v.transform(lambda s: s.ewm(alpha=0.4).mean())
    np.testing.assert_allclose(got, want, atol=1e-12)
