"""Fits that grow whole in a task, and the queries that run them at the published method's size."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.catalog import modelling
from truegauge.catalog.registry import Tables
from truegauge.operators import boosting, evaluate, models
from truegauge.operators.ordered import with_ordinal
from truegauge.plans import calibrate
from truegauge.spec import ModelParams


def tables(spark, at, n=700):
    """Orders whose lines make the truth a wavy function of the reading."""
    rng = np.random.default_rng(4)
    price = rng.uniform(1000.0, 9000.0, n).round(2)
    charge = price + 900.0 * np.sin(price / 700.0) + 400.0 * np.cos(price / 310.0)
    day = datetime(2024, 1, 1)
    orders = [(i, i % 7, "FO"[i % 2], float(price[i]), day + timedelta(hours=i), f"{i % 5 + 1}-X") for i in range(n)]
    lines = [(i, i, 1, j, float(5 + (i * j) % 11), float(charge[i] / 2), 0.0, 0.0, "A", "O", day) for i in range(n) for j in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    return Tables(spark, str(at))


@pytest.fixture
def fitted(monkeypatch):
    """Boosted models as they are fitted."""
    seen, plain = [], models.fit_boosted
    monkeypatch.setattr(models, "fit_boosted", lambda *a, **kw: seen.append(plain(*a, **kw)) or seen[-1])
    return seen


def test_residual_explainability_runs_all_rounds(spark, tmp_path, fitted):
    got = modelling.residual_explainability(tables(spark, tmp_path)).first()
    (model,) = fitted
    assert model.depth == 4 and sorted(r[0] for r in model.trees.groupBy("fold").count().select("count").collect()) == [150] * 5
    assert got.cv_r2_mean > 0.9  # 4 rounds of depth 3 reach 0.3


def values(model, by):
    return model.trees.select(*by, "_m", F.posexplode("tree").alias("v", "n")).select(*by, "_m", "v", "n.*").where("cover is not null").orderBy(*by, "_m", "v").toPandas()


@pytest.mark.parametrize("loss, signs", [("squared", None), ("squared", {"x": 1}), ("absolute", None), ("quantile", None)])
def test_whole_and_level_by_level_fits_agree(spark, monkeypatch, loss, signs):
    """Groups with rounds and depths of their own, few enough rows for their sketches to be exact, and work in several chunks."""
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], n), "x": rng.normal(size=n).round(2), "z": rng.integers(0, 5, n).astype(float), "w": rng.choice([0.5, 2.0], n)})
    pdf["y"] = np.where(pdf.x > 0, 3.0, -1.0) * pdf.z + rng.normal(size=n)
    pdf.loc[::13, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    settings = spark.createDataFrame([("a", 2, 2, 0.9)], "g string, max_iter int, max_depth int, learning_rate double")
    monkeypatch.setattr(boosting, "CHUNK", 101)
    monkeypatch.setattr(boosting, "CHUNK_CELLS", 300)
    found = []
    for most in (boosting.WHOLE_BYTES, 0):
        monkeypatch.setattr(boosting, "WHOLE_BYTES", most)
        model = boosting.fit_boosted(df, ["x", "z"], "y", ["g"], boosting.Loss(loss, 0.7 if loss == "quantile" else 0.5), ModelParams(max_iter=3, max_depth=3), "w", signs, settings)
        found.append(values(model, ["g"]))
    whole, levels = found
    same = ["g", "_m", "v", "feature", "threshold", "missing_left", "cover"]
    pd.testing.assert_frame_equal(whole[same], levels[same])
    np.testing.assert_allclose(whole.value, levels.value, rtol=1e-9, atol=1e-9)


def test_many_groups_share_tasks():
    assert boosting._parts([5, 900, 2], 8) == [0, 1, 2]
    assert boosting._parts([1, 1, 1, 9, 1, 1], 3) == [0, 0, 0, 1, 2, 2]


def test_boosted_squared_runs_all_rounds(spark, tmp_path, fitted):
    got = {r.model: r.r2 for r in modelling.boosted_squared(tables(spark, tmp_path)).collect()}
    (model,) = fitted
    assert model.depth == 4 and model.trees.count() == 200
    assert got["boosted"] > max(0.0, got["online"])


def test_random_search_runs_all_trials_of_every_group(spark, tmp_path, monkeypatch):
    """Every trial of the published search reaches the objective with its own rounds and depth; a group without enough rows has none."""
    asked = []

    def objective(parts):
        assert {g: p.count() for g, p in parts.items()} == {"ALL_DATA": 500, "F": 250, "O": 250}
        return lambda group, surface, params: asked.append((group, params)) or (1.0, 2.0)

    monkeypatch.setattr(modelling, "boosted_objective", objective)
    got = modelling.random_search(tables(spark, tmp_path, 500)).groupBy("group").count().collect()
    assert {r["group"]: r["count"] for r in got} == {"ALL_DATA": 50, "F": 40, "O": 40}
    assert {p.max_iter for g, p in asked} == set(range(100, 501, 50)) and {p.max_depth for g, p in asked} == set(range(3, 9))

    asked.clear()
    monkeypatch.setattr(modelling, "boosted_objective", lambda parts: lambda group, surface, params: (asked.append(group), (1.0, 2.0))[1])
    assert modelling.random_search(tables(spark, tmp_path / "few", 300)).count() == 50 and set(asked) == {"ALL_DATA"}


def test_trials_score_as_single_fits_do(spark, tmp_path):
    """An objective on rows with ordinals has the errors of a fit that numbers them itself."""
    rows = modelling.pair_rows(tables(spark, tmp_path, 300))
    params = ModelParams(damping=0.4, pos_boost=2.0, alpha_smoothing=0.6, max_iter=12, max_depth=3)
    numbered = with_ordinal(rows, modelling.ORDER, ["role"], "_i")
    got = modelling.boosted_objective({"ALL_DATA": numbered})("ALL_DATA", "Top", params)
    _, scored = calibrate.train_and_score(rows, modelling.PAIR_ROLES, params)
    want = evaluate.metric_row(scored, "truth", "online", "corrected").first()
    assert got == pytest.approx((want.rmse_model_test, max(want.pos_mae_model_test, want.neg_mae_model_test)), rel=1e-9)
