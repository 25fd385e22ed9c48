"""The operators bound to the driver tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm.common import table
from truegauge.llm.decontaminate import find_items
from truegauge.llm.edit_counts import apply_edits, count_trees
from truegauge.llm.factorisation import score, train
from truegauge.llm.html_text import extract
from truegauge.llm.lattice import score_texts
from truegauge.llm.licenses import scan
from truegauge.llm.ngram_join import link_classes
from truegauge.llm.oracles import ORACLE
from truegauge.llm.periodic import digests, find_runs, planted
from truegauge.llm.pieces import digest, encode
from truegauge.llm.pii import report
from truegauge.llm.prefix_trie import rebuilt, sequences, trie_nodes
from truegauge.llm.quality_rules import judged
from truegauge.llm.token_store import keys_of, read_store, write_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return judged(table(spark, root, "documents")).drop("clean_text")


@query("op2_html_text")
def html_text(spark: SparkSession, root: str) -> DataFrame:
    return extract(table(spark, root, "pages"))


@query("op3_token_store")
def token_store(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(store, keys_of(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_sentencepiece")
def sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return digest(encode(table(spark, root, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


@query("op5_ngram_join")
def ngram_join(spark: SparkSession, root: str) -> DataFrame:
    return link_classes(table(spark, root, "documents"), words=3, percent=90)


@query("op6_quality_classifier")
def quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return score(docs, train(docs, table(spark, root, "labels")), threshold=0.3)


@query("op7_edit_counts")
def edit_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of all documents, then of the same after three edits each: a replacement in the middle, a deletion, and a new beginning."""
    docs = table(spark, root, "documents")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    n = F.length("text").cast("long")
    one = lambda seq, start, end, text: F.struct(F.lit(seq).alias("seq"), start.alias("start"), end.alias("end"), F.lit(text).alias("replacement"))
    half, quarter, zero = F.floor(n / 2), F.floor(n / 4), F.lit(0).cast("long")
    edits = docs.where("doc_id is not null").select(
        "doc_id", F.inline(F.array(one(1, half, half + 12, "edited words"), one(2, quarter, quarter + 40, ""), one(3, zero, zero, "New first line.\n")))
    )
    after = apply_edits(count_trees(docs, path, pattern), edits, path, pattern)
    return after.select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded")


@query("op8_pii")
def pii(spark: SparkSession, root: str) -> DataFrame:
    return report(table(spark, root, "documents"))


@query("op9_license_scan")
def license_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan(table(spark, root, "documents"))


@query("op10_decontamination")
def decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = find_items(table(spark, root, "documents"), table(spark, root, "benchmark"), words=5, percent=80)
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


@query("op11_prefix_trie")
def prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return trie_nodes(rebuilt(sequences(table(spark, root, "conversations"))))


@query("op12_lattice_scores")
def lattice_scores(spark: SparkSession, root: str) -> DataFrame:
    return score_texts(table(spark, root, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return digests(find_runs(planted(table(spark, root, "documents"))))


def load():
    """(queries, SQL twins) of the package."""
    return dict(QUERIES), dict(ORACLE)
