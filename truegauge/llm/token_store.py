"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to places.

Layout of a store (one folder that all executors share):

* ``shard-<number>-<attempt>.ids``: nothing but token ids, little endian, 16 bits each if the vocabulary allows it, else 32. Shards hold documents in
  ascending key order, shard by shard.
* ``index-<part>-<attempt>.mph``: for the keys whose hash falls into this part, the bit arrays of the hash function and one slot for each key:
  fingerprint, shard, first id, number of ids.
* ``shards`` and ``parts``: small Parquet tables with the names of the files of successful tasks, and each shard's first id counted over the whole store. A
  file of a lost or repeated attempt is named by no table and never read.

The hash function is a cascade of bit arrays: a key whose place in a level is hit by no other key owns that bit, the others go to the next level.
A key's slot is the rank of its bit. A look-up reads a few bits and one slot, at any number of keys; a key that was never stored is told by its fingerprint.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, WordStore, kept, mix, ready, text_slices, word_spans
from truegauge.session import materialise, shared_dir

END = 1
#: A control character that stands between words when they are encoded together.
MARK = "\x01"
#: Keys that an index part is sized for, words kept encoded in a task, and bytes of text that are encoded at once.
PART_KEYS = 200_000
CACHED_WORDS = 1_000_000
ENCODE_BYTES = 1 << 20

#: Marks that end a run of letters or digits for sure, bytes behind which they may, and lower case of bytes.
_MARKS = np.isin(np.arange(256), list(b".,;:!?%&*$#"))
_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_LATIN = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) & ~np.isin(np.arange(256), [0x97, 0xB7])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)

_SEED = np.uint64(0x9E3779B97F4A7C15)
_FINGER = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class TokenStore:
    folder: str
    parts: int
    id_bytes: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def key_hashes(ids: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64-bit hash of (key, number of the row among those with this key); one to one while keys are unique."""
    h = mix(ids.astype(np.int64).view(np.uint64))
    h = np.where(null, mix(h ^ _FINGER), h)
    return np.where(copy > 0, mix(h + copy.astype(np.uint64) * _SEED), h)


class HashIndex:
    """Minimal perfect hash of a set of 64-bit key hashes; ``slots`` gives each known key its own number below ``len``."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray, fingers: np.ndarray, columns: dict[str, np.ndarray]):
        self.levels, self.rest, self.fingers, self.columns = levels, rest, fingers, columns
        words = np.concatenate([*levels, np.zeros(1, np.uint64)])
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        self.base = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return mix(keys + np.uint64(int(_SEED) * (level + 1) & (1 << 64) - 1)) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray, columns: dict[str, np.ndarray]) -> HashIndex:
        levels, left = [], keys
        while len(left) and len(levels) < 64:
            bits = (2 * len(left) + 63) // 64 * 64
            at = cls._place(left, len(levels), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        made = cls(levels, np.sort(left), np.zeros(0, np.uint32), {})
        slot = made.slots(keys, check=False)
        made.fingers = np.empty(len(keys), np.uint32)
        made.fingers[slot] = cls.finger(keys)
        for name, values in columns.items():
            made.columns[name] = np.empty_like(values)
            made.columns[name][slot] = values
        return made

    @staticmethod
    def finger(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _FINGER) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray, check: bool = True) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the index."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = self._place(keys[open_], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            mine = words[word]
            hit = (mine >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(mine & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.rank[self.base[level] + word] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.rank[-1] + at[hit]
        if check and len(self.fingers):
            out[(out >= 0) & (self.fingers[np.maximum(out, 0)] != self.finger(keys))] = -1
        return out

    def to_bytes(self) -> bytes:
        arrays = {"fingers": self.fingers, "rest": self.rest} | {f"c:{k}": v for k, v in self.columns.items()} | {f"l:{i}": x for i, x in enumerate(self.levels)}
        head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in arrays.values())

    @classmethod
    def from_bytes(cls, data: bytes) -> HashIndex:
        at = 8 + int.from_bytes(data[:8], "little")
        arrays = {}
        for name, kind, n in json.loads(data[8:at]):
            arrays[name] = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += arrays[name].nbytes
        levels = [arrays[f"l:{i}"] for i in range(sum(k.startswith("l:") for k in arrays))]
        return cls(levels, arrays["rest"], arrays["fingers"], {k[2:]: v for k, v in arrays.items() if k.startswith("c:")})


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, each distinct word (run without ASCII white space) once.

    Only for tokenizers that drop white space and never look across it, as word-end BPE does; :func:`splits_at_space` tells.
    Where the tokenizer's own rules allow (:func:`plain_rules`), words that differ in ASCII case are one word, and a word ends before a
    mark behind a letter or digit, so that fewer are distinct. Words that hold a byte an added token begins with stay as they are.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.hasher = WordHasher(fold=False)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.store = WordStore(CACHED_WORDS)
        self.plain = plain_rules(self.tokenizer)
        self.added = np.isin(np.arange(256), [t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has. Words go to the tokenizer many at a time with a mark between them, a word of its
        own that has one id; words that hold the mark go alone."""
        if len(self.mark) == 1 and not any(MARK in w for w in words):
            texts = [f" {MARK} ".join([*words[i : i + 500], ""]) for i in range(0, len(words), 500)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words):
                return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([y for x in got for y in x], dtype=np.uint32), np.array([len(x) for x in got])

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, ``END`` behind each, and each row's first id."""
        starts, ends, first = word_spans(raw, offsets)
        if self.plain and len(starts):
            raw, starts, ends, first = self.pieces(raw, starts, ends, first)
        rows = self.store.rows(self.hasher.of(raw, starts, ends), raw, starts, ends, self.encode_words)
        return self.store.gather(rows, first, END)

    def pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes, starts and ends of the words as they are cut at marks, and each row's first piece."""
        low, inside = _LOWER[raw], np.zeros(len(raw) + 1, dtype=bool)
        before = _ALNUM[raw]
        before[1:] |= _LATIN[raw[1:]] & (raw[:-1] == 0xC3)
        inside[1:-1] = before[:-1] & _MARKS[raw[1:]]
        inside[starts] = False
        for at in np.flatnonzero(self.added[raw]):
            w = np.searchsorted(starts, at, side="right") - 1
            if w >= 0 and at < ends[w]:
                low[starts[w] : ends[w]], inside[starts[w] : ends[w]] = raw[starts[w] : ends[w]], False
        cuts = np.flatnonzero(inside)
        new_starts = np.sort(np.concatenate([starts, cuts]))
        begin = np.append(starts, len(raw))[first]
        return low, new_starts, np.sort(np.concatenate([ends, cuts])), np.searchsorted(new_starts, begin, side="left")


def plain_rules(tokenizer) -> bool:
    """Whether the tokenizer's file shows that ASCII case makes no difference to it and that it always cuts between letters or digits and other marks."""
    file = json.loads(tokenizer.to_str())
    normal, cut = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = [x for x in normal.get("normalizers", [normal]) if x.get("type") not in ("NFC", "Lowercase")]
    folds = [x.get("type") for x in normal.get("normalizers", [normal])][-1:] == ["Lowercase"]
    spaces = all(x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in steps)
    parts = cut.get("pretokenizers", [cut])
    split = parts[0] if parts else {}
    words = split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and split.get("behavior") == "Removed" and split.get("invert") is True
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in parts[1:])
    return folds and spaces and words and rest and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in file.get("added_tokens", []))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_as_uri(folder))


def _as_uri(folder: str) -> str:
    if "://" in folder:
        return folder
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}"


def _write_shards(folder: str, path: str, id_bytes: int):
    """Sorted rows of one range to one raw file, and a row for each document: key, number among equal keys, place."""

    def run(batches):
        from pyspark import TaskContext

        shard, at, last, copy = TaskContext.get().partitionId(), 0, object(), 0
        files, root = _open(folder)
        name, sink, encoder = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            if sink is None:
                sink, encoder = files.open_output_stream(f"{root}/{name}"), kept("words", path, lambda: WordEncoder(path))
            for row, raw, offsets in text_slices(batch.column(1), ENCODE_BYTES):
                ids, first = encoder(raw, offsets)
                sink.write(ids.astype(f"<u{id_bytes}").tobytes())
                keys = batch.column(0).slice(row, len(offsets) - 1)
                copies = []
                for k in keys.to_pylist():
                    copy = copy + 1 if k == last else 0
                    last = k
                    copies.append(copy)
                n = len(copies)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(copies, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array(at + first[:-1]), pa.array(np.diff(first)), pa.array([name] * n)],
                    names=["doc_id", "copy", "shard", "at", "n", "file"],
                )
                at += int(first[-1])
        if sink is not None:
            sink.close()

    return run


def _key_columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    return batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), null, batch.column("copy").to_numpy(zero_copy_only=False)


def _by_part(batches):
    """Batches sorted by ``part``, joined to one batch a part."""
    held = []
    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if held and b > a and held[0].column("part")[0] != batch.column("part")[int(a)]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _write_index(folder: str):
    def run(batches):
        files, root = _open(folder)
        for batch in _by_part(batches):
            keys = key_hashes(*_key_columns(batch))
            made = HashIndex.build(keys, {c: batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("shard", "<u4"), ("at", "<u8"), ("n", "<u4"))})
            name = f"index-{batch.column('part')[0].as_py():06d}-{uuid.uuid4().hex}.mph"
            with files.open_output_stream(f"{root}/{name}") as sink:
                sink.write(made.to_bytes())
            yield pa.RecordBatch.from_arrays([batch.column("part").slice(0, 1), pa.array([name]), pa.array([len(keys)], pa.int64())], names=["part", "file", "keys"])

    return run


def _look_up(folder: str):
    """(part, doc_id, copy, file) sorted by part to (doc_id, copy, shard, at, n); keys that are not stored are left out."""

    def run(batches):
        files, root = _open(folder)
        for batch in _by_part(batches):
            with files.open_input_file(f"{root}/{batch.column('file')[0].as_py()}") as source:
                index = HashIndex.from_bytes(source.read())
            slot = index.slots(key_hashes(*_key_columns(batch)))
            have = slot >= 0
            got = [pa.array(index.columns[c][slot[have]].astype(np.int64)) for c in ("shard", "at", "n")]
            found = batch.filter(pa.array(have))
            yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("copy"), *got], names=["doc_id", "copy", "shard", "at", "n"])

    return run


def _read_ids(folder: str, id_bytes: int):
    """(doc_id, copy, at, n, file, start) sorted by place to the ids stored there."""

    def run(batches):
        files, root = _open(folder)
        name, source = None, None
        for batch in batches:
            ids, crc = [], []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n"))):
                if file != name:
                    name, source = file, files.open_input_file(f"{root}/{file}")
                data = np.frombuffer(source.read_at(n * id_bytes, at * id_bytes), dtype=f"<u{id_bytes}").astype("<u4")
                ids.append(data.astype(np.int32))
                crc.append(zlib.crc32(data.tobytes()))
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(crc, pa.int64()), flat], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer gives a text the ids of its white-space separated words, one after the other."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    probes = ["a b", "Don't 12 stop. éÅ", " x\ty\n\nz  ", "<|endoftext|> b'c"]
    return all(ids(p) == [i for w in p.split() for i in ids(w)] for p in probes)


def write_store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> TokenStore:
    """Encode every text with the tokenizer file ``path``, append ``END``, write shards and index; returns the store.

    Keys are whole numbers. NULL texts are empty documents (only ``END``). NULL keys come first. Rows that share a key are stored one after the
    other and numbered; such rows are in one shard. An empty table gives a store without shards. Other columns are ignored.
    """
    if not splits_at_space(path):
        raise ValueError(f"{path} looks across white space; encode it by whole texts")
    from tokenizers import Tokenizer

    spark = ready(docs.sparkSession)
    folder = _as_uri(folder or f"{shared_dir(spark)}/truegauge/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}")
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    id_bytes = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    placed = placed.mapInArrow(_write_shards(folder, path, id_bytes), "doc_id long, copy long, shard long, at long, n long, file string")
    placed = materialise(placed, "placed")
    sums = placed.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("shard", "file", "ids", F.coalesce(before, F.lit(0)).alias("first_id")).write.parquet(f"{folder}/shards")
    parts = max(1, -(-placed.count() // PART_KEYS))
    keyed = placed.withColumn("part", _part(parts)).select("part", "doc_id", "copy", "shard", "at", "n")
    keyed.repartition(min(parts, 4 * shards), "part").sortWithinPartitions("part").mapInArrow(_write_index(folder), "part long, file string, keys long").write.parquet(f"{folder}/parts")
    return TokenStore(folder, parts, id_bytes)


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts).cast("long"))


def read_store(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of the rows of ``keys`` (doc_id, copy) through the index; unknown keys have no row.

    ``start`` counts the ids of all documents before it in the store, ``ids_crc32`` covers the ids as 32-bit little-endian numbers.
    """
    spark = keys.sparkSession
    shards, parts = store.table(spark, "shards"), store.table(spark, "parts")
    asked = keys.select(F.col("doc_id").cast("long"), F.col("copy").cast("long")).withColumn("part", _part(store.parts))
    asked = asked.join(parts.select("part", "file"), "part").select("part", "doc_id", "copy", "file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = asked.repartition(min(store.parts, 4 * n), "part").sortWithinPartitions("part").mapInArrow(_look_up(store.folder), "doc_id long, copy long, shard long, at long, n long")
    placed = found.join(shards, "shard").withColumn("start", F.col("first_id") + F.col("at"))
    placed = placed.repartitionByRange(n, "start").sortWithinPartitions("start")
    return placed.select("doc_id", "copy", "at", "n", "file", "start").mapInArrow(
        _read_ids(store.folder, store.id_bytes), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    )


def keys_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, copy) of every row of ``docs``: rows that share a key are numbered from 0."""
    times = docs.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("times"))
    return times.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
