import numpy as np
import pytest

from truegauge.llm.factorisation import Machine, PLACES, fit, keep_good, score, train

ROOT = "/root/testdata/sf0.01"


def test_margin_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=PLACES), rng.normal(size=(PLACES, 8)).astype(np.float32))
    places, values, first = rng.integers(0, PLACES, 30), rng.normal(size=30), np.array([0, 12, 13, 30])
    for a, b, got in zip(first, first[1:], m.margin(places, values, first)):
        want = 0.3 + sum(m.linear[places[i]] * values[i] for i in range(a, b))
        want += sum(float(m.factors[places[i]] @ m.factors[places[j]]) * values[i] * values[j] for i in range(a, b) for j in range(a, i))
        assert got == pytest.approx(want, abs=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    machine = train(docs, labels)
    got = score(docs, machine).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.95 and (good >= 0.3).mean() > 0.97
    kept = keep_good(docs, machine)
    assert kept.columns == docs.columns and kept.count() == score(docs, machine).where("predicted = 1").count()


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (score(docs.where("doc_id < 100"), train(docs, x)).toPandas().sort_values("doc_id") for x in (labels, other))
    assert np.allclose(a.score, b.score)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 50, 9), (1, "word " * 50, 9), (None, None, None), (2, "", 0), (3, "é " * 60_000, 5)], "doc_id long, text string, score long")
    got = score(docs, train(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got) and {r.doc_id for r in got} == {1, 2, 3, None}
    one = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in score(docs, train(docs, one)).collect())
    assert score(docs.where("false"), fit([])).collect() == []
