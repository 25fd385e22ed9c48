"""Cases that once went wrong, and divisions on constant, single and missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.operators import aggregates, association, binning, diagnostics, models, ordered
from truegauge.sources import readers
from truegauge.streaming import queries as streams

CONSTANT = [("a", i, 3.0, float(i)) for i in range(30)]
SINGLE = [("a", 0, 3.0, 1.0)]
MISSING = [("a", i, None, None) for i in range(4)]
SCHEMA = "g string, k long, v double, x double"
OPERATORS = {
    "histogram": lambda d: binning.histogram(d, "v", 4, ["g"]),
    "equal_width": lambda d: binning.equal_width_bins(d, "v", 4, ["g"]),
    "quantile_bins": lambda d: binning.quantile_bins(d, "v", 4, ["g"]),
    "normality": lambda d: diagnostics.normality(d, "v", ["g"]),
    "shapiro_wilk": lambda d: diagnostics.shapiro_wilk(d, "v", ["k"], ["g"]),
    "levene": lambda d: diagnostics.heteroscedasticity(d, "x", "v", 4),
    "feature_tests": lambda d: diagnostics.with_f_p(diagnostics.feature_tests(d, "v", ["x"], ["g"], 4)),
    "ewma": lambda d: ordered.ewma(d, "v", ["k"], 0.5, ["g"]),
    "interpolate": lambda d: binning.interpolate(d, "v", d.select(F.col("x").alias("gx"), F.col("k").cast("double").alias("gy")), "gx", "gy", "y"),
}


@pytest.mark.parametrize("rows", [CONSTANT, SINGLE, MISSING, []], ids=["constant", "single", "missing", "empty"])
@pytest.mark.parametrize("name", OPERATORS)
def test_no_division_ends_a_query(spark, name, rows):
    if not hasattr(diagnostics if name == "autocorrelation" else association, {"autocorrelation": "autocorrelation", "pearson": "pearson_matrix"}.get(name, "__name__")):
        pytest.skip("named otherwise")
    OPERATORS[name](spark.createDataFrame(rows, SCHEMA)).collect()


@pytest.mark.parametrize("size", [7, 100, 1000])
@pytest.mark.parametrize("alpha", [0.3, 0.7])
def test_mean_stays_over_long_gaps(spark, size, alpha):
    x = [None if 400 <= i < 700 or 900 <= i < 1000 or i < 5 else float((i * 37) % 11) for i in range(1200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "k long, v double")
    got = ordered.ewma(df, "v", ["k"], alpha, size=size).toPandas().sort_values("k").smoothed.to_numpy()
    np.testing.assert_allclose(got, pd.Series(x, dtype=float).ewm(alpha=alpha).mean().to_numpy(), atol=1e-9)


def test_shapiro_wilk_sizes(spark):
    rng = np.random.default_rng(2)
    groups = {3: [1.0, 2.0, 4.0], 4: [1.0, 2.0, 4.0, 9.0], 5: [1.0, 2.0, 4.0, 9.0, 9.5], 5001: rng.normal(size=5001).tolist()}
    rows = [(str(n), i, float(v)) for n, values in groups.items() for i, v in enumerate(values)] + [("same", i, 1.0) for i in range(9)]
    got = {r.g: r for r in diagnostics.shapiro_wilk(spark.createDataFrame(rows, "g string, k long, v double"), "v", ["k"], ["g"]).collect()}
    assert got["3"].w == pytest.approx(0.964286, abs=1e-5) and got["3"].w_p == pytest.approx(0.636886, abs=1e-4)
    assert 0.8 < got["4"].w < 1 and 0.8 < got["5"].w < 1 and got["5001"].w > 0.99 and not got["5001"].p_in_range
    assert got["same"].w is None


def test_missing_objective_is_never_best(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 0.5, 2), ("b", float("nan"), 3), ("b", 0.7, 4), ("c", None, 5)], "tag string, v double, i int")
    assert {r.tag: r.i for r in aggregates.best_per_tag(df, "tag", [F.col("v"), F.col("i")]).collect()} == {"a": 2, "b": 4, "c": 5}


def test_header_below_a_banner(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("Report June,,\n a ,b,c\n" + f"1,x,{n}\n5,b,6\n\n7,y,8\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "20b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.offset_header_csv(spark, str(tmp_path), [" a ", "b", "c"], 1)
            assert sorted(map(tuple, got.collect())) == sorted([("1", "x", str(n)) for n in range(3)] + [("5", "b", "6"), ("7", "y", "8")] * 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_encoding_is_told_by_the_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,plain\n2,镀层\n".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("k,v\n3,镀层\n".encode())
    got = readers.lab_csv(spark, str(tmp_path), spark.createDataFrame([], "k int, v string").schema)
    assert sorted(map(tuple, got.collect())) == [(1, "plain"), (2, "镀层"), (3, "镀层")]


def test_monotone_score_depends_on_its_row_alone(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([1, 4, 9, None, 12])], "k long, x double")
    predict = lambda d: d.withColumn("predicted_delta", F.coalesce(F.sin("x"), F.lit(0.25)))
    score = lambda d: {r.k: r.predicted_delta for r in models.monotone_scores(d, predict, "x", ["k"], 8, span=(0.0, 10.0)).collect()}
    every = score(df)
    assert every[3] == 0.25 and all(score(df.where(F.col("k") == k))[k] == every[k] for k in every)
    assert every[0] >= every[1] >= every[2] >= every[4]


def test_interpolation_of_a_hot_value(spark):
    grid = spark.createDataFrame([(0.0, 0.0), (10.0, 100.0)], "gx double, gy double")
    df = spark.createDataFrame([(i, 5.0 if i % 2 else None) for i in range(40)] + [(99, -3.0), (100, 30.0)], "k long, v double")
    got = {r.k: r.y for r in binning.interpolate(df, "v", grid, "gx", "gy", "y").collect()}
    assert len(got) == 42 and got[1] == 50.0 and got[0] is None and got[99] == 0.0 and got[100] == 100.0


def test_lost_state_is_an_error(spark, tmp_path):
    handle = streams.smoothing_batches("v", ["k"], ["g"], 0.5, str(tmp_path / "o"), str(tmp_path / "s"))
    df = spark.createDataFrame(CONSTANT, SCHEMA)
    handle(df, 0)
    handle(df, 1)
    with pytest.raises(FileNotFoundError):
        handle(df, 5)
