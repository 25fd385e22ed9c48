"""Helpers the operators share: batch access to text bytes, word and shingle hashes, bounded bitmaps."""

from __future__ import annotations

import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.session import READ_BYTES, prepare

#: Bytes of text that are expanded into numpy arrays at once.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = np.uint64(int(_rng.integers(0, 1 << 63)) * 8 + 5 & (1 << 64) - 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def ready(spark: SparkSession) -> SparkSession:
    """Adaptive settings, and batches small enough that one of long texts fits a worker and is no large object to an executor's heap."""
    prepare(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "200")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return ready(spark).read.option("parquet.read.allocation.size", READ_BYTES).parquet(f"{root.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, although ``body`` uses it many times."""
    return F.transform(F.array(value), body)[0]


#: Rows (of a few numbers each) up to which a written table is broadcast, some 30 MB.
SMALL_ROWS = 400_000


def small(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``SMALL_ROWS`` rows; else it is joined by shuffling."""
    return F.broadcast(written) if written.count() <= SMALL_ROWS else written


def kept(name: str, token: str, make):
    """An object that a worker process keeps from task to task, made by ``make`` when ``token`` is new: models and caches, never results.

    Functions are sent by value, so their globals don't outlive a task; a module of its own does.
    """
    home = sys.modules.setdefault("truegauge_kept", types.ModuleType("truegauge_kept")).__dict__
    if home.get(name, (None,))[0] != token:
        home[name] = (token, make())
    return home[name][1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (constants of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of whole rows with about ``most`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        end = min(end, len(column))
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (a run of bytes that ``space`` doesn't mark, never across rows), and per row
    the index of its first word (one more entry than rows)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~space[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


class WordHasher:
    """Hashes words of whole slices. Made inside a task, where it keeps the powers of its base."""

    def __init__(self, fold: bool = True):
        self.values = _FOLDED if fold else _TABLE
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of every white-space separated word, A-Z folded if asked for; and each row's first word."""
        starts, ends, first = word_spans(raw, offsets)
        return self.of(raw, starts, ends), first

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the given stretches of bytes."""
        if len(self.up) <= len(raw):
            size = (len(raw) + (1 << 16)) // (1 << 16) * (1 << 16) + 1
            p = np.full((2, size), _BASE, dtype=np.uint64)
            p[1], p[:, 0] = _INVERSE, 1
            self.up, self.down = np.cumprod(p, axis=1, dtype=np.uint64)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class WordStore:
    """Id sequences of words that a task has encoded already, by the words' hashes; emptied when ``most`` is reached.

    Hashes are looked up many at a time in a table with open addresses that is never more than half full.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def __len__(self) -> int:
        return len(self.first) - 1

    def clear(self) -> None:
        self.places, self.keys = np.full(1 << 12, -1, np.int32), np.zeros(0, np.uint64)
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of every hash in the store, -1 for those it doesn't have."""
        mask = np.uint64(len(self.places) - 1)
        at = hashes & mask
        out = self.places[at]
        far = np.flatnonzero(out >= 0)
        far = far[self.keys[out[far]] != hashes[far]]
        while len(far):
            at[far] = (at[far] + np.uint64(1)) & mask
            out[far] = self.places[at[far]]
            far = far[out[far] >= 0]
            far = far[self.keys[out[far]] != hashes[far]]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Words that the store doesn't have, each once."""
        fresh = np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        self.keys = np.concatenate([self.keys, hashes])
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        if 2 * len(self) > len(self.places):
            self.places = np.full(1 << (4 * len(self) - 1).bit_length(), -1, np.int32)
            fresh = np.arange(len(self), dtype=np.int32)
        mask = np.uint64(len(self.places) - 1)
        at = self.keys[fresh] & mask
        while len(fresh):
            free = self.places[at] < 0
            self.places[at[free]] = fresh[free]
            left = self.places[at] != fresh
            fresh, at = fresh[left], (at[left] + np.uint64(1)) & mask

    def rows(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Place of every word in the store; words it doesn't have are decoded and given to ``encode`` (a list of strings to ids and lengths)."""
        out = self.find(hashes)
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            code, new = pd.factorize(hashes[lacking])
            if len(self) + len(new) > self.most and len(self):
                self.clear()
                return self.rows(hashes, raw, starts, ends, encode)
            where = np.empty(len(new), dtype=np.int64)
            where[code[::-1]] = lacking[::-1]
            out[lacking] = len(self) + code
            data = raw.tobytes()
            self.add(new, *encode([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist())]))
        return out

    def gather(self, rows: np.ndarray, first: np.ndarray, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``rows`` of all documents (``first``: each document's first word), ``tail`` behind each document, and where documents begin."""
        length = np.diff(self.first)[rows] if len(rows) else np.zeros(0, np.int64)
        end = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[np.repeat(self.first[rows] - end[:-1], length) + np.arange(end[-1])] if len(rows) else self.flat[:0]
        bounds = end[first]
        if tail is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint32(tail)), bounds + np.arange(len(bounds))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words of one document in order; with fewer words, of the whole sequence; none without
    words."""
    n = len(words)
    width = min(k, n)
    if not n:
        return words
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        acc = mix(acc * _STEP + words[j : n - width + 1 + j])
    return acc


def run_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of all rows of a slice at once: hashes, and each row's first one."""
    count = np.diff(first)
    have = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(have)))
    got = np.empty(out[-1], dtype=np.uint64)
    if len(words) >= k:
        acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            acc = mix(acc * _STEP + words[j : len(words) - k + 1 + j])
        long = np.flatnonzero(count >= k)
        if len(long):
            source = np.repeat(first[long] - out[long], have[long])
            place = np.concatenate([np.arange(out[i], out[i + 1]) for i in long]) if len(long) < len(count) else np.arange(out[-1])
            got[place] = acc[place + source]
    for i in np.flatnonzero((count > 0) & (count < k)):
        got[out[i]] = shingles(words[first[i] : first[i + 1]], k)[0]
    return got, out


def bit_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each 64-bit key in a bitmap of ``2 ** bits`` bits."""
    h = mix(keys.astype(np.uint64) + _STEP)
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def in_bitmap(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key may be in the set the bitmap was made of (never a wrong no)."""
    a, b = bit_places(keys, bits)
    one = np.uint64(1)
    look = lambda p: (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & one
    return (look(a) & look(b)).astype(bool)


def bitmap_of(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Two-probe bitmap of a long column, merged by a distributed bit-or. Its size depends on ``bits`` alone, so it may be
    handed to every task however many keys there are."""

    def places(batches):
        for batch in batches:
            got = np.concatenate(bit_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            got = np.unique(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array((got >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (got & np.uint64(63))).view(np.int64))], names=["w", "m"]
            )

    def packed(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if parts:
            w, m = (np.concatenate(x).astype(np.int64).tobytes() for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary()), pa.array([m], pa.binary())], names=["w", "m"])

    rows = keys.where(F.col(column).isNotNull()).select(column).mapInArrow(places, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m"))
    words = np.zeros(max(1, (1 << bits) >> 6), dtype=np.uint64)
    for w, m in rows.mapInArrow(packed, "w binary, m binary").collect():
        words[np.frombuffer(w, np.int64)] = np.frombuffer(m, np.int64).view(np.uint64)
    return words
