import re
from urllib.parse import unquote, urlparse

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_decontaminate import grams
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_pii import brute as personal
from truegauge.llm.common import table
from truegauge.llm.factorisation import score, train
from truegauge.session import materialise

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    extra = [(10**6, None, "en", "x", None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, docs.first().text, "en", "x", 1), (None, "A plain text that has no key of its own.", None, None, None)]
    out = [docs.unionByName(spark.createDataFrame(extra, docs.schema))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], ROOT).cache())
    yield [d.collect() for d in out], out
    for d in out[1:]:
        d.unpersist()


def test_quality(spark, stages):
    (all_, good, *_), frames = stages
    want = {r.doc_id for r in score(frames[0], train(frames[0], spark.read.parquet(f"{ROOT}/labels.parquet"))).where("predicted = 1").collect()}
    assert {r.doc_id for r in good} == want and set(good) <= set(all_) and frames[1].columns == frames[0].columns


def test_near_copies(stages):
    (_, good, once, *_), frames = stages
    label = {i: c for i, _, c in classes([(r.doc_id, r.text) for r in good], 5, 80)}
    assert {r.doc_id for r in once} == {i for i, c in label.items() if i == c or i is None} and set(once) <= set(good)


def test_decontamination(spark, stages):
    (_, _, once, clean, *_), frames = stages
    items = [grams(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    leaked = lambda t: any(b and 100 * len(grams(t) & b) >= 80 * len(b) for b in items)
    assert {r.doc_id for r in clean} == {r.doc_id for r in once if not leaked(r.text)} and set(clean) <= set(once)


def test_personal_data(stages):
    (_, _, _, clean, hidden, _), frames = stages
    before = {r.doc_id: r for r in clean}
    assert {r.doc_id for r in hidden} == set(before) and frames[4].columns == frames[0].columns
    for r in hidden:
        assert not personal(r.text) and (r.n_chars == (None if r.text is None else len(r.text))) and r.lang == before[r.doc_id].lang
        outside = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SSN|LOCAL_PHONE|SECRET)\]", r.text or "")
        at = 0
        for part in outside:
            at = (before[r.doc_id].text or "").index(part, at) + len(part)


def test_tokens(stages):
    (*_, hidden, ids), _ = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text or "" for r in hidden}
    assert len(ids) == len(hidden) and all(list(r.ids) == library.encode(text[r.doc_id]) and r.decoded == text[r.doc_id] for r in ids)


def test_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, ROOT)
    assert got.where("not round_trip").count() == 0 and got.count() > 0


def test_scratch_tables_and_readers_hold_little_at_once(spark, tmp_path):
    """Whole pages and column batches of texts filled the executors' heap: row groups are small, and so are the batches that readers hand on."""
    wide = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(40)])
    made = materialise(spark.range(0, 12_000, 1, 1).select("id", wide.alias("text")), "wide")
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in made.inputFiles()]
    sizes = [f.row_group(i).column(1).total_compressed_size for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) > 20 << 20 and max(sizes) < 18 << 20
    made.write.parquet(str(tmp_path / "documents.parquet"))
    seen = table(spark, str(tmp_path), "documents").agg(F.count("text"), F.sum("id")).first()
    assert tuple(seen) == (12_000, 71_994_000) and int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 200
