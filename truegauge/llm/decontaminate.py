"""Finds short test items inside documents of any length: size-partitioned MinHash containment search, exact verification.

Items are partitioned by size: class ``c`` holds those with ``2**c`` to ``2**(c+1) - 1`` distinct shingles. For each class every document is cut into
windows of ``2**(c+2)`` shingles that overlap by half, so item and window are of like size and a MinHash comparison makes sense although the
whole document is much larger. A window is a candidate for an item if one of ``hashes`` minima agrees. With 64 minima a contained item is missed with a
probability below 2e-5 at containment 0.8, wherever its shingles stand in the document. Agreement means a shared shingle, so candidates are rare.

The items' minima reach the tasks as a bitmap of fixed size; documents without a hit leave at once. Hits are joined with the signature
table, and each candidate pair is verified on the words themselves: shared distinct shingles over the item's distinct shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, bind, bitmap_of, in_bitmap, mix, ready, run_shingles, small, text_slices
from truegauge.session import materialise

#: log2 of the bits of the bitmap of all item minima (8 MB); more items than it can tell apart only mean more candidates.
BITS = 26


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 64, hashes, dtype=np.uint64), rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tag(size: int, k):
    return np.uint64(size << 32) + np.uint64(1) + np.asarray(k, dtype=np.uint64)


def _item_minima(words: int, hashes: int):
    """(item, text) to (item, size, key): one key for each hash function."""

    def run(batches):
        hasher, (seed, odd) = WordHasher(), _functions(hashes)
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                got, first = run_shingles(*hasher(raw, offsets), words)
                for i, item in enumerate(batch.column(0).slice(row, len(offsets) - 1).to_pylist()):
                    own = np.unique(got[first[i] : first[i + 1]])
                    if len(own):
                        size = len(own).bit_length() - 1
                        least = np.array([((own ^ s) * o).min() for s, o in zip(seed, odd)], dtype=np.uint64)
                        keys = mix(least ^ _tag(size, np.arange(hashes))).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([item] * hashes, pa.int64()), pa.array([size] * hashes, pa.int64()), pa.array(keys)], names=["item", "size", "key"]
                        )

    return run


def _window_hits(words: int, hashes: int, sizes: list[int], bits):
    """(doc_id, text) to (doc_id, text, keys): documents with a window minimum that some item may have."""

    def run(batches):
        hasher, (seed, odd) = WordHasher(), _functions(hashes)
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                got, first = run_shingles(*hasher(raw, offsets), words)
                if not len(got):
                    continue
                grids = _grids(first, [1 << (s + 1) for s in sizes])
                docs, keys = [], []
                for k in range(hashes):
                    low = (got ^ seed[k]) * odd[k]
                    for size, (starts, doc, same) in zip(sizes, grids):
                        low = np.minimum.reduceat(low, starts)
                        window = low.copy()
                        window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                        key = mix(window ^ _tag(size, k))
                        hit = in_bitmap(bits.value, key, BITS)
                        if hit.any():
                            docs.append(doc[hit])
                            keys.append(key[hit])
                if docs:
                    docs, keys = np.concatenate(docs), np.concatenate(keys)
                    by = np.lexsort((keys, docs))
                    docs, keys = docs[by], keys[by]
                    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])))
                    docs, keys = docs[new], keys[new]
                    rows, begin = np.unique(docs, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64)))
                    found = batch.take(pa.array(rows + row))
                    yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), lists], names=["doc_id", "text", "keys"])

    return run


def _grids(first: np.ndarray, lengths: list[int]):
    """For each block length (each a multiple of the one before): where blocks start among the blocks before (among the
    shingles, for the first), the row of each block, and whether the next block is of the same row."""
    out = []
    filled = np.flatnonzero(np.diff(first) > 0)
    count, start, step = np.diff(first)[filled], first[:-1][filled], 1
    for length in lengths:
        ratio, step = length // step, length
        blocks = -(-count // ratio)
        doc = np.repeat(filled, blocks)
        begin = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        inner = np.arange(len(doc)) - np.repeat(begin, blocks)
        out.append((np.repeat(start, blocks) + inner * ratio, doc, doc[1:] == doc[:-1]))
        count, start = blocks, begin
    return out


def exact_shingles(text: Column, words: int) -> Column:
    """Distinct word n-grams of a text as strings (words joined by one space); the whole sequence if it is shorter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.filter(F.split(F.translate(text, upper, lower), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, words), " "))
    return bind(parts, lambda w: F.when(F.size(w) > 0, F.array_distinct(grams(w))).otherwise(F.array().cast("array<string>")))


def find_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    words: int = 5, percent: int = 80, hashes: int = 64,
) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_item, n_shared, containment, same``.

    An item is found if at least ``percent`` of its distinct shingles occur in the document. Items and documents that are NULL, empty or without
    words have no shingles and never match; a text shorter than a shingle is one shingle. Rows with equal keys are looked at
    one by one, and equal result rows (repeated documents or items) are reported once. ``same`` is the MD5 of the document's text. NULL keys are kept.
    Other columns are ignored. Empty tables give an empty table.
    """
    spark = ready(docs.sparkSession)
    listed = items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_text is not null").distinct()
    listed = materialise(listed.withColumn("item", F.monotonically_increasing_id()), "items")
    minima = materialise(listed.select("item", "item_text").mapInArrow(_item_minima(words, hashes), "item long, size long, key long"), "minima")
    sizes = sorted(r[0] for r in minima.select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap_of(minima, "key", BITS))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = rows.mapInArrow(_window_hits(words, hashes, sizes, bits), f"doc_id {kind}, text string, keys array<long>")
    hits = materialise(hits.withColumn("rid", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("rid", F.explode("keys").alias("key")).join(minima, "key").select("rid", "item").distinct()
    known = listed.select("item", "item_id", exact_shingles(F.col("item_text"), words).alias("wanted"))
    met = pairs.join(known, "item").join(hits.select("rid", "doc_id", "text"), "rid")
    met = met.withColumn("n_shared", F.size(F.array_intersect("wanted", exact_shingles(F.col("text"), words))).cast("long"))
    met = met.withColumn("n_item", F.size("wanted").cast("long")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return met.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"), F.md5("text").alias("same")).distinct()


def without_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` in which no item is found (arguments as for :func:`find_items`); NULL and empty texts stay."""
    found = find_items(docs, items, key, text, **how).select(F.col("doc_id").alias("_key"), F.col("same").alias("_same")).distinct()
    found = small(materialise(found, "leaks"))
    return docs.join(found, F.col(key).eqNullSafe(found["_key"]) & (F.md5(F.col(text).cast("string")) == found["_same"]), "left_anti")
