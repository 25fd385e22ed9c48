"""The keyed smoothing operator against the batch mean, over micro-batches, restarts, NULL and hot groups, expiry and given starts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.streaming import queries as streams
from truegauge.streaming.keyed import combine, keyed_smoothing

SCHEMA = "g string, k long, ts timestamp, v double"


def rows(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.34, "hot", np.array(["a", "b", None], dtype=object)[rng.integers(0, 3, n)])
    v = rng.normal(size=n).astype(object)
    v[rng.random(n) < 0.2] = None
    v[700:900] = None
    return pd.DataFrame({"g": g, "k": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 97, unit="s"), "v": v})


def run(spark, tmp_path, batches, **more):
    src, out, chk = (str(tmp_path / c) for c in ("in", "out", "chk"))
    for part in batches:
        spark.createDataFrame([(g, int(k), t.to_pydatetime(), v) for g, k, t, v in part.itertuples(index=False)], SCHEMA).repartition(3).write.mode("append").parquet(src)
        # A new query from the checkpoint each time: every micro-batch is a restart.
        stream = streams.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        smooth = keyed_smoothing(stream, "v", "ts", ["ts", "k"], ["g"], 0.3, **more)
        smooth.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).toPandas().sort_values("k").reset_index(drop=True)


def batch_mean(pdf):
    return pdf.assign(v=pdf.v.astype(float)).groupby("g", dropna=False).v.transform(lambda s: s.ewm(alpha=0.3).mean())


def test_equals_the_batch_mean(spark, tmp_path):
    pdf = rows()
    got = run(spark, tmp_path, [pdf[i : i + 300] for i in range(0, 1500, 300)], sub_seconds=5000)
    assert got.k.tolist() == pdf.k.tolist() and got.columns.tolist() == ["g", "k", "ts", "v", "smoothed"]
    np.testing.assert_allclose(got.smoothed.astype(float), batch_mean(pdf), atol=1e-12)


def test_start_and_expiry(spark, tmp_path):
    at = lambda day, i: pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, seconds=i)
    part = lambda day, groups: pd.DataFrame([(g, 10 * day + i, at(day, i), float(i)) for g in groups for i in range(3)], columns=["g", "k", "ts", "v"])
    batches = [part(0, ["a", "b"]), part(1, ["a"]), part(9, ["a"]), part(10, ["a"]), part(11, ["a", "b"])]
    initial = spark.createDataFrame([("b", 5.0, 2.0)], "g string, sub_mean double, sub_weight double")
    got = run(spark, tmp_path, batches, ttl_seconds=5 * 86400, initial=initial)
    first = got[(got.g == "b") & (got.k == 0)].smoothed.item()
    assert first == pytest.approx((5.0 * 2 * 0.7 + 0.0) / (2 * 0.7 + 1))
    again = got[(got.g == "b") & (got.k == 110)].smoothed.item()
    assert again == 0.0  # nothing for eleven days: starts anew
    stays = got[(got.g == "a") & (got.k == 110)].smoothed.item()
    assert stays != 0.0


def test_combining_is_associative():
    rng = np.random.default_rng(3)
    for _ in range(50):
        parts = [(float(rng.normal()), float(rng.random() * 3), 0.7 ** int(rng.integers(1, 5))) for _ in range(3)]
        (a, b, c) = parts
        left = combine(*combine(a[0], a[1], b[0], b[1], b[2]), c[0], c[1], c[2])
        right = combine(a[0], a[1], *combine(b[0], b[1], c[0], c[1], c[2]), b[2] * c[2])
        assert left == pytest.approx(right)
    assert combine(2.0, 1.0, None, 0.0, 0.5) == (2.0, 0.5) and combine(None, 0.0, 3.0, 1.0, 0.1) == (3.0, 1.0)
