"""Plans read their input once."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.catalog import streams as stream_queries
from truegauge.catalog.registry import Tables
from truegauge.operators import association, binning, boosting
from truegauge.plans import calibrate


def test_soft_sensor_reads_its_texts_once(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(400), "side": ["a", "b"] * 200, "x": rng.normal(size=400).round(3), "h": rng.normal(size=400).round(3)})
    pdf["near"], pdf["lab"] = 2 * pdf.x + pdf.h, 3 * pdf.x - pdf.h + rng.normal(size=400)
    rows = spark.createDataFrame(pdf)
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.StringType())
    def text(x):
        seen.add(1)
        return str(x)

    dirty = rows.select("id", "side", F.when(F.col("id") == 7, F.lit("/")).otherwise(text("x")).alias("x"), *[F.col(c).cast("string") for c in ("h", "near", "lab")])
    got = {(r["side"], r["route"]): r for r in calibrate.soft_sensor(dirty, "id", "x", "h", {"n": "near", "l": "lab"}, "side").collect()}
    assert seen.value == 400
    assert set(got) == {("a", "n"), ("a", "l"), ("b", "n"), ("b", "l")}
    assert got["a", "n"]["chosen"] and not got["a", "l"]["chosen"]
    for s in "ab":
        part = pdf[(pdf.side == s) & (pdf.id != 7)]
        assert got[s, "l"]["correlation"] == pytest.approx(part.x.corr(part.lab), abs=1e-12)


@pytest.mark.parametrize("name", ["stream_flags", "stream_flags_with_limits"])
def test_coil_streams_merge_the_coils_once(spark, tmp_path, monkeypatch, name):
    day = datetime(2024, 1, 1)
    orders = [(i, i % 7, "FOP"[i % 3], 1000.0 + i, day + timedelta(days=i), f"{i % 5 + 1}-X") for i in range(60)]
    lines = [(i, i, 1, j, float(5 + j), 900.0 + i, 0.05, 0.01 * j, "A", "O", day) for i in range(60) for j in range(1, 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    arrived, plain = [], stream_queries.arrive
    monkeypatch.setattr(stream_queries, "arrive", lambda df, *a: arrived.append(df) or plain(df, *a))
    got = getattr(stream_queries, name)(Tables(spark, str(tmp_path)))
    assert got.count() == 60
    assert "Join" not in arrived[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_near_and_far_fits_agree(spark, monkeypatch, by):
    """Few groups go by arrays, many by expressions: equal trees, NULL groups and missing values included."""
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], n), "x": rng.normal(size=n).round(2), "z": rng.integers(0, 5, n).astype(float), "w": rng.choice([0.5, 2.0], n)})
    pdf["y"] = np.where(pdf.x > 0, 3.0, -1.0) * pdf.z + rng.normal(size=n)
    pdf.loc[::13, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    for loss, signs in (("squared", None), ("absolute", {"z": 1})):
        trees = []
        for cells in (boosting.NEAR_CELLS, 0):
            monkeypatch.setattr(boosting, "NEAR_CELLS", cells)
            model = boosting.fit_boosted(df, ["x", "z"], "y", by, boosting.Loss(loss), boosting.ModelParams(max_iter=3, max_depth=3), "w", signs)
            rows = model.trees.select(*by, "_m", F.posexplode("tree").alias("v", "n")).select(*by, "_m", "v", "n.*").where("cover is not null").orderBy(*by, "_m", "v").toPandas()
            trees.append(rows)
        near, far = trees
        leaves = near.feature.isna()
        pd.testing.assert_frame_equal(near[[*by, "_m", "v", "feature", "threshold", "missing_left", "cover"]], far[[*by, "_m", "v", "feature", "threshold", "missing_left", "cover"]])
        assert near.value[leaves].to_numpy() == pytest.approx(far.value[leaves].to_numpy(), rel=1e-9)


def test_walk_is_not_a_nest_of_expressions(spark):
    """The last level's sums of a near fit come from a plan that doesn't grow with the level."""
    sizes = []
    for level in (1, 4):
        near = boosting._Near([[np.array([0.0])]], np.array([0.1]), 1, 63)
        trees = spark.createDataFrame([(0, [(0, 0, False)] + [None] * 62, [0.0] * 63)], f"_slot int, _splits array<{boosting.SPLIT}>, _value array<double>")
        rows = spark.sql("select 0 as _slot, array(cast(id % 2 as short)) as _bins, 1.0D as _y, 0.0D as _f, 1.0D as _w from range(40)")
        sums = near.histograms(rows, trees, F.col("_y"), level, 2)
        sizes.append(len(sums._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        if level == 1:
            assert sorted(map(tuple, sums.collect())) == [(0, 1, 0, 0, 20.0, 20.0, 20), (0, 2, 0, 1, 20.0, 20.0, 20)]
    assert sizes[0] == sizes[1]


def test_robust_lowess_looks_its_curve_up_without_ordering_the_rows_again(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(300), "x": rng.integers(0, 60, 300).astype(float)})
    pdf["y"] = np.sin(pdf.x / 9) + rng.normal(size=300) / 5
    pdf.loc[::40, "y"] += 30
    ordered, plain = [], association.with_ordinal
    monkeypatch.setattr(association, "with_ordinal", lambda *a, **kw: ordered.append(1) or plain(*a, **kw))
    monkeypatch.setattr(binning, "forward_fill", lambda *a, **kw: pytest.fail("rows are ordered again"))
    got = association.lowess(spark.createDataFrame(pdf), "x", "y", "k", points=21, robust=2).orderBy("point").toPandas()
    assert len(ordered) == 1

    rows = pdf.sort_values(["x", "k"])
    x, y, n, k = rows.x.to_numpy(), rows.y.to_numpy(), 300, 90
    at = x[[j * (n - 1) // 20 for j in range(21)]]
    h = np.array([np.sort(np.abs(x - a))[k - 1] for a in at])
    w0 = np.ones(n)
    for turn in range(3):
        fit = []
        for a, r in zip(at, h):
            d = x - a
            w = np.where(np.abs(d) < r, (1 - (np.abs(d) / r) ** 3) ** 3, 0) * w0
            fit.append(np.linalg.solve([[w.sum(), (w * d).sum()], [(w * d).sum(), (w * d * d).sum()]], [(w * y).sum(), (w * d * y).sum()])[0])
        gx, first = np.unique(at, return_index=True)
        res = np.abs(y - np.interp(x, gx, np.array(fit)[first]))
        u = res / (6 * np.median(res))
        w0 = np.where(u < 1, (1 - u * u) ** 2, 0)
    assert got.fitted.to_numpy() == pytest.approx(np.array(fit), abs=1e-9)
