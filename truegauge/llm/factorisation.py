"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into ``1 << WORD_BITS`` places (counts, scaled to length one), one place for the bin of each structure statistic and one
for the bin of the recorded length. The score is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is half of
``|sum v_i x_i|^2 - sum |v_i x_i|^2``, so a document costs as much as it has entries.

The model is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows (the documented bound; a fixed hash of the key chooses them), whose vectors the
executors make. Everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, ready, text_slices

WORD_BITS = 15
RANK = 8
TRAIN_ROWS = 6000
EPOCHS = 15
BATCH = 128
BINS = 12
#: Edges of the bins of the structure statistics; shares are per word or per character.
EDGES = {
    "words": 2.0 ** np.arange(1, 12), "word_length": np.arange(2.0, 13), "symbols": np.geomspace(0.002, 1.5, 11), "digits": np.geomspace(0.002, 0.6, 11),
    "upper": np.geomspace(0.004, 0.9, 11), "calls": np.geomspace(0.002, 1.5, 11), "bars": np.geomspace(0.002, 1.0, 11), "stops": np.geomspace(0.005, 0.5, 11),
    "same_next": np.geomspace(0.002, 0.9, 11), "distinct": np.linspace(0.05, 0.95, 11), "lines": np.geomspace(0.002, 0.3, 11), "beyond_ascii": np.geomspace(0.002, 0.8, 11),
    "recorded": 4.0 ** np.arange(1, 12),
}
PLACES = (1 << WORD_BITS) + BINS * len(EDGES)


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    one_of = lambda s: np.isin(b, list(s.encode()))
    return {
        "symbols": one_of("#*$%&<>{}[]\\^~=_@"), "digits": (b >= 48) & (b <= 57), "upper": (b >= 65) & (b <= 90), "calls": one_of("!?"), "bars": one_of("|"),
        "stops": one_of(".,;:"), "lines": b == 10, "beyond_ascii": b >= 192,
    }


def vectors(raw: np.ndarray, offsets: np.ndarray, recorded: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of all rows of a slice, row after row, and each row's first entry."""
    rows = len(offsets) - 1
    hashes, first = hasher(raw, offsets)
    n, size = np.diff(first), np.diff(offsets)
    row = np.repeat(np.arange(rows), n)
    code, count = np.unique((row << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    owner, place = code >> WORD_BITS, code & ((1 << WORD_BITS) - 1)
    norm = np.sqrt(np.bincount(owner, weights=count.astype(float) ** 2, minlength=rows))
    value = count / norm[owner]
    share = lambda x, of: x / np.maximum(of, 1)
    stats = {"words": n.astype(float), "distinct": share(np.bincount(owner, minlength=rows), n)}
    follows = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), out=follows[2:])
    stats["same_next"] = share(follows[first[1:]] - follows[first[:-1]], n)
    sums = np.zeros(len(raw) + 1, dtype=np.int64)
    for name, members in _classes().items():
        np.cumsum(members[raw], out=sums[1:])
        got = sums[offsets[1:]] - sums[offsets[:-1]]
        stats[name] = share(got, size if name in ("upper", "beyond_ascii", "lines", "digits") else n)
    stats["word_length"] = share(size - n, n)
    stats["recorded"] = np.nan_to_num(recorded.astype(float), nan=0.0)
    bins = np.stack([np.searchsorted(edges, stats[name]) for name, edges in EDGES.items()], axis=1)
    bins += (1 << WORD_BITS) + BINS * np.arange(len(EDGES))
    every = np.concatenate((owner, np.repeat(np.arange(rows), len(EDGES))))
    by = np.argsort(every, kind="stable")
    places = np.concatenate((place, bins.ravel()))[by]
    values = np.concatenate((value, np.full(bins.size, 1 / np.sqrt(len(EDGES)))))[by]
    return places, values, np.concatenate(([0], np.cumsum(np.bincount(every, minlength=rows))))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, places: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        terms = self.factors[places] * values[:, None].astype(np.float32)
        starts = first[:-1]
        total = np.add.reduceat(terms, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", terms, terms), starts)
        return self.bias + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * ((total**2).sum(1) - squares)

    def scores(self, places, values, first) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(places, values, first), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> Machine:
    """Logistic loss, AdaGrad on mini-batches. Without rows of both labels the score is the same for all."""
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], dtype=float)
    m = Machine(0.0, np.zeros(PLACES), np.zeros((PLACES, RANK), np.float32))
    if not len(rows) or labels.min() == labels.max():
        m.bias = 0.0 if not len(rows) else 2.0 * (2 * labels[0] - 1)
        return m
    m.factors = rng.normal(0, 0.05, (PLACES, RANK)).astype(np.float32)
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(PLACES, 1e-6), np.full((PLACES, RANK), 1e-6, np.float32), 1e-6
    for epoch in range(EPOCHS):
        rate = 0.15 / (1 + epoch / 4)
        for chosen in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            places = np.concatenate([rows[i][1] for i in chosen])
            values = np.concatenate([rows[i][2] for i in chosen])
            length = np.array([len(rows[i][1]) for i in chosen])
            first = np.concatenate(([0], np.cumsum(length)))
            error = (m.scores(places, values, first) - labels[chosen]) / len(chosen)
            own = np.repeat(np.arange(len(chosen)), length)
            terms = m.factors[places] * values[:, None].astype(np.float32)
            total = np.add.reduceat(terms, first[:-1], axis=0)
            step = (error[own] * values)[:, None] * (total[own] - terms)
            used, at = np.unique(places, return_inverse=True)
            dw = np.bincount(at, weights=error[own] * values) + 1e-5 * m.linear[used]
            dv = np.stack([np.bincount(at, weights=step[:, k]) for k in range(RANK)], axis=1) + 1e-4 * m.factors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            m.linear[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= (0.3 * rate * dv / np.sqrt(gv[used])).astype(np.float32)
            m.bias -= 0.3 * rate * float(error.sum()) / np.sqrt(gb)
    return m


def held_out(key: str):
    """Rows that are never learned from: crc32 of the key's text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _input(docs: DataFrame, key: str, text: str, length: str) -> DataFrame:
    recorded = F.col(length).cast("double") if length in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), recorded.alias("recorded"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", length: str = "n_chars") -> Machine:
    """Machine fitted on at most ``TRAIN_ROWS`` labelled rows that are not held out. Labels other than 0 and 1 and NULL keys are left out; of a key with several labels the
    largest counts."""
    ready(docs.sparkSession)
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").where(~held_out("_id"))
    chosen = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    sample = _input(docs, key, text, length).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_y", "text", "recorded", F.xxhash64("_id").alias("_h"))

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                recorded = batch.column(2).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                places, values, first = vectors(raw, offsets, recorded, hasher)
                cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(first, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(offsets) - 1), cut(places, "<u2" if PLACES <= 1 << 16 else "<u4"), cut(values, "<f4"), batch.column(3).slice(row, len(offsets) - 1)],
                    names=["y", "places", "values", "h"],
                )

    kind = "<u2" if PLACES <= 1 << 16 else "<u4"
    got = sample.mapInArrow(run, "y int, places binary, values binary, h long").orderBy("h", F.md5("places")).limit(2 * TRAIN_ROWS).collect()
    return fit([(r.y, np.frombuffer(r.places, kind).astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in got])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """Per row: ``doc_id, held_out, score`` (0 to 1, higher for good documents) and ``predicted`` (1 from ``threshold`` on).

    NULL and empty texts are scored by their (empty) structure. NULL keys and repeated rows pass through; ``length`` may be missing or NULL. Nothing else of a row is read.
    """
    ready(docs.sparkSession)
    rows = _input(docs, key, text, length)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(machine)), f"doc_id {kind}, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _scorer(model, keep: bool = False):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            out = []
            for row, raw, offsets in text_slices(batch.column("text")):
                recorded = batch.column("recorded").slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                out.append(model.value.scores(*vectors(raw, offsets, recorded, hasher)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=[batch.schema.names[0], "score"])

    return run


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with all their columns."""
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"), (F.col(length).cast("double") if length in docs.columns else F.lit(None).cast("double")).alias("recorded"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(machine)), f"row {kind}, score double")
    return scored.where(F.col("score") >= threshold).select("row.*")
