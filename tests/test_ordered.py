import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.operators import ordered
from truegauge.operators.quantiles import average_ranks, exact_quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 900
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
            "t": rng.permutation(n),
            "v": np.round(rng.normal(size=n), 2),
        }
    )
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf.sort_values("t").reset_index(drop=True), df


def test_ordinal_spans_partitions(frame):
    pdf, df = frame
    got = ordered.with_ordinal(df, ["t"], ["g"], partitions=7).toPandas().sort_values("t").reset_index(drop=True)
    assert (got.idx == pdf.groupby("g").cumcount()).all()
    whole = ordered.with_ordinal(df, ["t"], partitions=7).toPandas().sort_values("t")
    assert whole.idx.tolist() == list(range(len(pdf)))


def test_forward_fill(frame):
    pdf, df = frame
    got = ordered.forward_fill(df, ["t"], ["v"], ["g"], partitions=6).toPandas().sort_values("t").reset_index(drop=True)
    want = pdf.groupby("g").v.ffill()
    np.testing.assert_allclose(got.v, want)


@pytest.mark.parametrize("window", [5, 12])
def test_rolling_over_block_borders(frame, window):
    pdf, df = frame
    got = (
        ordered.rolling_stats(df, "v", ["t"], ["g"], window, min_periods=3, size=64, partitions=5)
        .toPandas().sort_values("t").reset_index(drop=True)
    )
    r = pdf.groupby("g").v.rolling(window, min_periods=3)
    np.testing.assert_allclose(got.roll_mean, r.mean().reset_index(0, drop=True).sort_index(), atol=1e-12)
    np.testing.assert_allclose(got.roll_std, r.std().reset_index(0, drop=True).sort_index(), atol=1e-9)
    mid = (
        ordered.rolling_centred(df, "v", ["t"], window, ["g"], size=64, partitions=5)
        .toPandas().sort_values("t").reset_index(drop=True)
    )
    want = pdf.groupby("g").v.rolling(window, min_periods=5, center=True).mean().reset_index(0, drop=True).sort_index()
    np.testing.assert_allclose(mid.trend, want, atol=1e-12)


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9, 1.0])
@pytest.mark.parametrize("size", [32, 1 << 16])
def test_ewma_matches_pandas(frame, alpha, size):
    pdf, df = frame
    got = (
        ordered.ewma(df.where("v is not null"), "v", ["t"], alpha, ["g"], size=size, partitions=5)
        .toPandas().sort_values("t").reset_index(drop=True)
    )
    p = pdf.dropna().reset_index(drop=True)
    want = p.groupby("g").v.transform(lambda s: s.ewm(alpha=alpha).mean())
    np.testing.assert_allclose(got.smoothed, want, atol=1e-11)


def test_trend_line_window_grows_with_group(frame):
    pdf, df = frame
    got = ordered.trend_line(df, "v", ["t"], ["g"], share=6, partitions=5).toPandas().sort_values("t").reset_index(drop=True)

    def line(s):
        if len(s) <= 50:
            return pd.Series(np.nan, index=s.index)
        return s.rolling(max(20, len(s) // 6), center=True, min_periods=5).mean()

    np.testing.assert_allclose(got.trend, pdf.groupby("g").v.transform(line), atol=1e-11)


def test_null_group_is_a_group(spark):
    df = spark.range(40).select(F.when(F.col("id") % 3 == 0, F.lit("a")).alias("g"), "id")
    got = ordered.with_ordinal(df, ["id"], ["g"], partitions=4).toPandas()
    assert sorted(got[got.g.isna()].idx) == list(range(26))
    got = exact_quantiles(df, "id", {"m": 0.5}, ["g"], partitions=4).toPandas()
    assert sorted(got.m) == [19.5, 19.5]


def test_ewma_gaps_and_seed(frame):
    pdf, df = frame
    got = ordered.ewma(df, "v", ["t"], 0.3, ["g"], partitions=5).toPandas().sort_values("t").reset_index(drop=True)
    np.testing.assert_allclose(got.smoothed, pdf.groupby("g").v.transform(lambda s: s.ewm(alpha=0.3).mean()), atol=1e-11)
    seeded = ordered.ewma(df.withColumn("s", F.lit(4.0)), "v", ["t"], 0.3, ["g"], seed="s", partitions=5)
    got = seeded.toPandas().sort_values("t").reset_index(drop=True)
    want = pdf.groupby("g").v.transform(lambda s: pd.concat([pd.Series([4.0]), s]).ewm(alpha=0.3).mean().iloc[1:].values)
    np.testing.assert_allclose(got.smoothed, want, atol=1e-11)


def test_quantiles_and_ranks(frame):
    pdf, df = frame
    probs = {"q05": 0.05, "q25": 0.25, "med": 0.5, "q99": 0.99, "lo": 0.0, "hi": 1.0}
    got = exact_quantiles(df, "v", probs, ["g"], partitions=6).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").v.quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got[list(probs)], want.sort_index(), atol=1e-12)
    ranks = average_ranks(df, "v", partitions=6).toPandas().set_index("v")["rank"]
    np.testing.assert_allclose(pdf.v.dropna().map(ranks), pdf.v.dropna().rank(), atol=1e-12)


@pytest.mark.parametrize("prune", [True, False, None])
def test_merge_is_the_same_with_and_without_pruning(spark, prune):
    from truegauge.operators import merge

    master = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, s string")
    sub = spark.createDataFrame([(" 1 ", 5.0), ("1", 7.0), ("3", 1.0), (None, 9.0)], "k string, v double")
    got = merge.merge_one(master, "k", merge.SubTable(sub, "k", {"v": "mean"}), prune).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in got] == [(1, 6.0), (2, None), (4, None)]
    inner = merge.merge_one(master, "k", merge.SubTable(sub, "k", {"v": "sum"}, unmatched="drop"), prune).collect()
    assert [(r["k"], r["v"]) for r in inner] == [(1, 12.0)]
