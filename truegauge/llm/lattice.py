"""Subword lattice likelihood: all segmentations of a text into known pieces, weighted and summed.

The vocabulary is an existing one and stays as it is. Its scores are the prior weights of its pieces: log probabilities of a unigram model as they
are, ranks of a merge vocabulary as a Zipf law. The weights then follow the training documents by expectation steps over the lattices of their
distinct words (each counted as often as it stands there), with the prior as a Dirichlet prior. A text is its words, each behind a mark for its
start, and one end; no piece reaches over the start of a word, so its probability is the product over words of the sum over
segmentations, a log-space forward recursion. Characters without piece take the weights of their bytes.

On Spark: one table of distinct words with their counts is gathered from all documents and shuffled by word. Lattices run once per
distinct word and step, not per occurrence. Words that make up a fixed share of all tokens are at most ``1 / share`` many; only
these are sent to every task. All others are joined by their hash, so no join key holds more than that share of the tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, mix, ready, text_slices, word_spans
from truegauge.session import materialise

SPACE = "▁"
#: Pseudo-observations that the vocabulary's own scores count for, per piece.
PRIOR = 0.1
ROUNDS = 2
#: A word with at least this share of the training tokens is sent to every task: at most 200,000 words.
SHARE = 1 / 200_000
#: Words of more characters are walked edge by edge, shorter ones of equal length together.
LONG = 96
#: Characters of equally long words that advance together.
CELLS = 1 << 18
_FACTOR = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_BITS = 20
_LOG10 = math.log(10)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the rows' characters, hashed, times powers of the base."""
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(codes.shape[1] - 1, _FACTOR))), dtype=np.uint64)
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _FACTOR) * up, axis=1, out=out[:, 1:])
    return out


def _keys(sums: np.ndarray, length: int, down: np.ndarray) -> np.ndarray:
    """Hash of every substring of ``length`` characters."""
    return mix((sums[:, length:] - sums[:, :-length]) * down[: sums.shape[1] - length] + np.uint64(length))


@dataclass
class Vocabulary:
    """Pieces by the hash of their characters, and the prior share of every symbol: pieces, 256 bytes, the end."""

    keys: np.ndarray
    ids: np.ndarray
    longest: int
    prior: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, pieces: list[str], scores: list[float]) -> Vocabulary:
        """Of pieces with ``SPACE`` at most in front. Scores that are no log probabilities (all whole numbers, or their exponentials
        sum to more than one) are ranks."""
        keys = np.zeros(len(pieces), dtype=np.uint64)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        for n in np.unique(size[size > 0]):
            own = np.flatnonzero(size == n)
            sums = _sums(np.array([list(map(ord, pieces[i])) for i in own], dtype=np.uint64))
            keys[own] = _keys(sums, int(n), np.ones(1, np.uint64))[:, 0]
        order = np.argsort(keys, kind="stable")
        s = np.asarray(scores, dtype=float)
        if (s == np.round(s)).all() or np.exp(np.minimum(s, 50)).sum() > 1.01:
            rank = np.empty(len(s))
            rank[np.argsort(-s, kind="stable")] = np.arange(len(s))
            weight = 1 / (rank + 10)
        else:
            weight = np.exp(s)
        least = weight.min() if len(weight) else 1.0
        prior = np.concatenate([weight, np.full(256, least), [weight.mean() if len(weight) else 1.0]])
        maybe = np.zeros(1 << _BITS, dtype=bool)
        maybe[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return cls(keys[order], np.arange(len(pieces))[order], int(size.max(initial=1)), prior / prior.sum(), maybe)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        known = [(p, model.get_score(i)) for i in ids if (p := model.id_to_piece(i)) and SPACE not in p[1:]]
        return cls.of(*map(list, zip(*known)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat places of the hashes that are pieces, and their pieces."""
        flat = keys.ravel()
        at = np.flatnonzero(self.maybe[(flat & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
        hit = self.keys[row] == flat[at]
        return at[hit], self.ids[row[hit]]


class Lattices:
    """Sums over the segmentations of words, under one weighting."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.v = vocabulary
        with np.errstate(divide="ignore"):
            self.log = np.log(weights)
        self.n = len(weights) - 257
        self.end = float(self.log[-1])

    def of_bytes(self, code: int) -> list[int]:
        return [self.n + b for b in chr(code).encode("utf-8", "replace")]

    def __call__(self, words: list[str], counts: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Log probability of every word; with ``counts``, the expected uses of every symbol are added ``into``."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            n = int(size[order[a]]) + 1
            step = max(1, CELLS // n) if n <= LONG else 1
            for s in range(a, b, step):
                own = order[s : min(b, s + step)]
                codes = np.frombuffer("".join(SPACE + words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
                weight = None if counts is None else counts[own].astype(float)
                out[own] = self._batch(codes, weight, into) if n <= LONG else self._walk(codes, weight, into)
        return out

    def _edges(self, codes: np.ndarray):
        """Per length: flat places (row times possible starts plus start) and pieces; and the places of single characters without piece."""
        sums, n = _sums(codes), codes.shape[1]
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BACK))), dtype=np.uint64)
        found = [self.v.find(_keys(sums, k, down)) for k in range(1, min(n, self.v.longest) + 1)]
        bare = np.ones(codes.size, dtype=bool)
        bare[found[0][0]] = False
        return found, np.flatnonzero(bare)

    def _bare(self, codes: np.ndarray, bare: np.ndarray):
        """Distinct characters among ``bare`` places, each place's number among them, and their log weights."""
        kind, distinct = pd.factorize(codes.ravel()[bare])
        symbols = [self.of_bytes(int(c)) for c in distinct]
        return kind, symbols, np.array([self.log[s].sum() for s in symbols])

    def _batch(self, codes: np.ndarray, weight, into) -> np.ndarray:
        m, n = codes.shape
        found, bare = self._edges(codes)
        kind, symbols, cost = self._bare(codes, bare)
        gain = []  # per length, log weight of the piece from each start, -inf for none; only lengths that occur
        for k, (at, piece) in enumerate(found, 1):
            if k == 1 or len(at):
                g = np.full(m * (n - k + 1), -np.inf)
                g[at] = self.log[piece]
                if k == 1 and len(bare):
                    g[bare] = cost[kind]
                gain.append((k, g.reshape(m, n - k + 1)))
        ahead = np.full((m, n + 1), -np.inf)
        ahead[:, 0] = 0
        for e in range(1, n + 1):
            ahead[:, e] = _log_sum([ahead[:, e - k] + g[:, e - k] for k, g in gain if k <= e])
        if weight is not None:
            behind = np.full((m, n + 1), -np.inf)
            behind[:, n] = 0
            for s in range(n - 1, -1, -1):
                behind[:, s] = _log_sum([behind[:, s + k] + g[:, s] for k, g in gain if k <= n - s])
            total = ahead[:, n]
            for k, g in gain:
                at, piece = found[k - 1]
                row, start = np.divmod(at, n - k + 1)
                share = np.exp(ahead[row, start] + self.log[piece] + behind[row, start + k] - total[row]) * weight[row]
                into += np.bincount(piece, share, minlength=len(into))
            if len(bare):
                row, start = np.divmod(bare, n)
                share = np.bincount(kind, np.exp(ahead[row, start] + cost[kind] + behind[row, start + 1] - total[row]) * weight[row], minlength=len(symbols))
                for s, x in zip(symbols, share):
                    np.add.at(into, s, x)
        return ahead[:, n]

    def _walk(self, codes: np.ndarray, weight, into) -> np.ndarray:
        """One long word, edge by edge: only pieces that occur are looked at."""
        n = codes.shape[1]
        found, bare = self._edges(codes)
        kind, symbols, cost = self._bare(codes, bare)
        start = np.concatenate([at for at, _ in found] + [bare])
        end = start + np.concatenate([np.full(len(at), k) for k, (at, _) in enumerate(found, 1)] + [np.ones(len(bare), np.int64)])
        gain = np.concatenate([self.log[p] for _, p in found] + [cost[kind] if len(bare) else np.zeros(0)])
        symbol = np.concatenate([p for _, p in found] + [-1 - kind])
        ahead = _sweep(n, start, end, gain)
        if weight is not None:
            behind = _sweep(n, n - end, n - start, gain)[::-1]
            share = np.exp(ahead[start] + gain + behind[end] - ahead[n]) * weight[0]
            known = symbol >= 0
            into += np.bincount(symbol[known], share[known], minlength=len(into))
            for s, x in zip(symbols, np.bincount(-1 - symbol[~known], share[~known], minlength=len(symbols))):
                np.add.at(into, s, x)
        return ahead[n:]


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    x = np.stack(parts)
    top = x.max(axis=0)
    top = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(axis=0))


def _sweep(n: int, start: np.ndarray, end: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Forward sums at all places of one word, from its edges."""
    order = np.lexsort((start, end))
    out = [-math.inf] * (n + 1)
    out[0] = 0.0
    at, total, exp, log = 0, -math.inf, math.exp, math.log
    for s, e, g in zip(start[order].tolist(), end[order].tolist(), gain[order].tolist()):
        if e != at:
            out[at] = total if at else 0.0
            at, total = e, -math.inf
        x = out[s] + g
        if x > total:
            x, total = total, x
        if x > -math.inf:
            total += log(1 + exp(x - total))
    out[at] = total if at else 0.0
    return np.array(out)


def word_table(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(h, word, c): every distinct word of all texts, A-Z folded, its hash and how often the training texts have it."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, raw, offsets in text_slices(batch.column(0)):
                starts, ends, first = word_spans(raw, offsets)
                code, distinct = pd.factorize(hasher.of(raw, starts, ends).view(np.int64))
                uses = np.bincount(code, np.repeat(learn[row : row + len(first) - 1], np.diff(first)), minlength=len(distinct))
                where = np.empty(len(distinct), dtype=np.int64)
                where[code[::-1]] = np.arange(len(code))[::-1]
                data = _LOWER[raw].tobytes()
                words = pa.array([data[starts[w] : ends[w]] for w in where], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int64()), words, pa.array(uses.astype(np.int64))], names=["h", "word", "c"])

    return docs.select(text, train).mapInArrow(run, "h long, word string, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Weights of all symbols, and the counts that the words' own frequencies need."""

    weights: np.ndarray
    tokens: int
    distinct: int
    ends: int


def fit(words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Weights after ``rounds`` expectation steps over a written :func:`word_table`, and its totals; ``ends`` is the number of training texts."""
    spark = words.sparkSession
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    start = vocabulary.prior * (prior * len(vocabulary.prior))
    weights = vocabulary.prior
    for _ in range(rounds if tokens else 0):
        now = spark.sparkContext.broadcast((tuple(vars(vocabulary).values()), weights))

        def step(batches, now=now):
            lattices = Lattices(Vocabulary(*now.value[0]), now.value[1])
            uses = np.zeros(len(now.value[1]))
            for batch in batches:
                lattices(batch.column(0).to_pylist(), batch.column(1).to_numpy(), uses)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], names=["symbol", "uses"])

        # One row a symbol of the vocabulary comes back, however many words there are.
        got = _wide(words.where("c > 0").select("word", "c"), step, "symbol long, uses double").groupBy("symbol").agg(F.sum("uses").alias("uses")).collect()
        uses = start.copy()
        uses[[r.symbol for r in got]] += [r.uses for r in got]
        uses[-1] += ends
        weights = uses / uses.sum()
    return Model(weights, int(tokens) + ends, int(distinct) + (ends > 0), ends)


def _wide(rows: DataFrame, step, schema: str) -> DataFrame:
    """``mapInArrow`` over rows of single words, which may travel in larger batches than whole texts."""
    return rows.mapInArrow(lambda batches: step(_merged(batches)), schema)


def _merged(batches, rows: int = 20_000, size: int = 4 << 20):
    """Arrow batches put together up to a number of rows and bytes."""
    held, n, b = [], 0, 0
    for batch in batches:
        held, n, b = [*held, batch], n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, b = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def held_out(key) -> F.Column:
    """Whether the unsigned crc32 of the key as text divides by 10; rows without key are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def score_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Per row: its key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (both log10).

    ``score`` is the marginal probability of the text over all segmentations into the pieces of the vocabulary file ``path``, ``base_score`` that of
    its words as independent draws with 0.1 added to every count. Learned from rows that are not :func:`held_out`. Tokens are the words, A-Z
    folded, and one end. NULL and empty texts are one end; rows without key are scored, not learned from, and count as held out; repeated rows
    give a row each and count each; without training rows the vocabulary's own scores decide. Other columns are not read. Words are
    joined by 64-bit hashes.
    """
    ready(docs.sparkSession)
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(path)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held_out(key).alias("held_out")).withColumn("train", ~F.col("held_out"))
    words = materialise(word_table(rows, "text", "train"), "words")
    ends = rows.where("train").count()
    model = fit(words, ends, vocabulary, rounds)
    now = spark.sparkContext.broadcast((tuple(vars(vocabulary).values()), model.weights))

    def lattice(batches):
        lattices = Lattices(Vocabulary(*now.value[0]), now.value[1])
        for batch in batches:
            score = lattices(batch.column(1).to_pylist()) / _LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["h", "c", "lp"])

    scored = materialise(_wide(words, lattice, "h long, c long, lp double"), "scored")
    base = math.log10(model.tokens + 0.1 * (model.distinct + 1))
    common = spark.sparkContext.broadcast(_packed(scored.where(F.col("c") >= F.lit(max(1.0, share * model.tokens)))))
    last = (int(ends > 0), math.log10(ends + 0.1) - base, math.log10(max(model.weights[-1], 1e-300)))

    def run(batches):
        hasher = WordHasher()
        h0, c0, lp0 = common.value
        base0 = np.log10(c0 + 0.1) - base
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column("text")):
                h, first = hasher(raw, offsets)
                h = h.view(np.int64)
                n = len(first) - 1
                doc = np.repeat(np.arange(n), np.diff(first))
                at = np.minimum(np.searchsorted(h0, h), max(0, len(h0) - 1))
                hit = h0[at] == h if len(h0) else np.zeros(len(h), bool)
                sums = [np.bincount(doc[hit], w, minlength=n) for w in (np.ones(hit.sum()), base0[at[hit]], lp0[at[hit]])] if len(h0) else [np.zeros(n)] * 3
                d, x = doc[~hit], h[~hit]
                order = np.lexsort((x, d))
                d, x = d[order], x[order]
                new = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(x, prepend=0) != 0) | (np.arange(len(d)) == 0))
                uses = np.diff(np.append(new, len(d)))
                d, x = d[new], x[new]
                # One row a text carries its sums, with a key of its own that is no word.
                own = np.concatenate([np.arange(n), d])
                none = np.zeros(len(d))
                mark = mix((np.arange(n) + first[:-1]).astype(np.uint64) + _FACTOR).view(np.int64)
                rid, key_ = batch.column("rid").slice(row, n), batch.column("key").slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        rid.take(pa.array(own)), key_.take(pa.array(own)), pa.array(np.concatenate([mark, x])), pa.array(np.concatenate([np.zeros(n, np.int64), uses])),
                        pa.array(np.concatenate([np.diff(first) + 1, none.astype(np.int64)])), *[pa.array(np.concatenate([s + e, none])) for s, e in zip(sums, last)],
                    ],
                    names=["rid", "key", "h", "uses", "n", "known", "base", "lp"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.select(F.monotonically_increasing_id().alias("rid"), "key", "text").mapInArrow(run, f"rid long, key {kind}, h long, uses long, n long, known double, base double, lp double")
    lookup = scored.select(F.col("h").alias("_h"), (F.col("c") > 0).cast("double").alias("_known"), (F.log10(F.col("c") + 0.1) - F.lit(base)).alias("_base"), F.col("lp").alias("_lp"))
    both = parts.join(lookup, F.col("h") == F.col("_h"), "left")
    add = lambda own, looked: F.sum(F.col(own) + F.when(F.col("uses") > 0, F.col("uses") * F.col(looked)).otherwise(0.0))
    sums = both.groupBy("rid", "key").agg(F.sum("n").alias("n_tokens"), add("known", "_known").alias("n_known"), add("base", "_base").alias("base_score"), add("lp", "_lp").alias("score"))
    return sums.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _packed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, c, lp) of a bounded table as arrays, by hash."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["h", "c", "lp"])

    got = _wide(rows.select("h", F.col("c").cast("double"), "lp"), pack, "h binary, c binary, lp binary").collect()
    h, c, lp = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[i], kind) for r in got]]) for i, kind in enumerate((np.int64, float, float)))
    order = np.argsort(h, kind="stable")
    return h[order], c[order], lp[order]
