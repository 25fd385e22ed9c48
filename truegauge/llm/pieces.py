"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A text is cut into words (spaces and the characters behind them; no piece of a usable model crosses that cut). Distinct words of a worker process are encoded once, words of equal length
together: the words form a matrix of code points, hashes of all substrings come from prefix sums, and each is looked up among the sorted hashes of the pieces. The search
then goes through the positions; for all words at once the best piece that ends there is the maximum over the possible lengths, and its length is the backpointer.

Unigram models maximise the sum of the pieces' scores. For BPE models that sum is not what defines the result: there, a segmentation is right exactly if
every two neighbouring pieces are what merging their joined text by rank gives. So a path may only go on with a piece that is a valid neighbour of the last one (validity of a pair
is found by merging, in batches, and remembered), and one valid path ends at each position. Words that no valid path reaches are merged by rank directly.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, WordStore, kept, mix, ready, text_slices

SPACE = "▁"
CACHED_WORDS = 250_000
ENCODE_BYTES = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
MAYBE_BITS = 20
#: Slots of the store of known piece pairs (9 bytes each); a new pair takes the place of the old one in its slot.
PAIR_BITS = 20
#: Words of more characters are first cut wherever no piece reaches over.
LONG = 64
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message: numbers for varints, bytes otherwise."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """Vocabulary of a model: pieces with scores, how to segment, and what to do with characters that have no piece."""

    def __init__(self, pieces: list[str], scores, kind: int, unknown: int = 0, bytes_at: int | None = None, prefix: bool = True, usable=None):
        self.pieces, self.scores, self.kind = pieces, np.asarray(scores, dtype=float), kind
        self.unknown, self.bytes_at, self.prefix = unknown, bytes_at, prefix
        self.longest = max((len(p) for p in pieces), default=1)
        usable = np.ones(len(pieces), bool) if usable is None else np.asarray(usable)
        ids = np.flatnonzero(usable)
        keys = np.array([_hash_text(pieces[i]) for i in ids], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        self.maybe = np.zeros(1 << MAYBE_BITS, dtype=bool)  # by a hash's low bits: most substrings are no piece and need no search
        self.maybe[(keys & np.uint64((1 << MAYBE_BITS) - 1)).astype(np.int64)] = True
        self.worst = float(self.scores[ids].min()) - 10 if len(ids) else -10.0
        if any(SPACE in pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece reaches over the start of a word")
        out = [p.replace(SPACE, " ").encode() for p in pieces]
        for i, p in enumerate(pieces):
            if not usable[i]:
                out[i] = bytes([i - bytes_at]) if bytes_at is not None and 0 <= i - bytes_at < 256 else " ⁇ ".encode() if i == unknown else b""
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.concatenate(([0], np.cumsum([len(x) for x in out])))

        if kind == BPE:
            self._derive(usable)

    def _derive(self, usable: np.ndarray) -> None:
        """How merging by rank makes each piece: its last two parts, and its rank (0 for characters, which nothing makes)."""
        n = len(self.pieces)
        size = np.array([len(p) for p in self.pieces])
        self.rank, self.left, self.right = np.zeros(n, np.int64), np.arange(n), np.arange(n)
        made = np.flatnonzero(usable & (size > 1))
        self.rank[made[np.argsort(-self.scores[made], kind="stable")]] = np.arange(1, len(made) + 1)
        self.sums, self.up = np.zeros(n, np.uint64), np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max(initial=1)), _FACTOR))), dtype=np.uint64)
        self.size = size
        dead = []
        for length in np.unique(size[usable]):
            own = np.flatnonzero(usable & (size == length))
            codes = np.array([list(map(ord, self.pieces[i])) for i in own], dtype=np.uint64)
            self.sums[own] = _sums(codes)[:, -1]
            if length > 1:
                ids, lengths, cut = merge_by_rank(self, codes)
                whole = lengths[:, 0] == length
                dead += own[~whole].tolist()
                self.left[own[whole]], self.right[own[whole]] = cut[whole].T
        if dead:  # never the result of merging
            live = ~np.isin(self.ids, dead)
            self.keys, self.ids = self.keys[live], self.ids[live]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined texts of two pieces by rank gives these two: no merge across their border may come before the merges that
        take the border's two symbols away. Follows both pieces' derivations back, the later merge first."""
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rows, a, b = np.arange(len(a)), a.copy(), b.copy()
        while len(rows):
            x, y = a[rows], b[rows]
            whole = self.probe(mix(self.sums[x] + self.up[self.size[x]] * self.sums[y] + (self.size[x] + self.size[y]).astype(np.uint64)))
            crossed = (whole >= 0) & (self.rank[whole] < limit[rows])
            good[rows[crossed]] = False
            later = self.rank[x] > self.rank[y]
            limit[rows] = np.where(later, self.rank[x], self.rank[y] + 1)
            a[rows], b[rows] = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
            rows = rows[~crossed & (later | (self.rank[y] > 0))]
        return good

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = dict((k, v) for k, v in _fields(f.read()) if k in (2, 3))
        trainer, normaliser = dict(_fields(model[2])), dict(_fields(model.get(3, b"")))
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only models that leave characters and spaces as they are")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        at = next((i for i in range(n) if sp.is_byte(i)), None)
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], trainer.get(3, UNIGRAM), sp.unk_id(), at, bool(normaliser.get(3, 1)), usable)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 for none."""
        flat = keys.ravel()
        out = np.full(flat.shape, -1, dtype=np.int64)
        near = np.flatnonzero(self.maybe[(flat & np.uint64((1 << MAYBE_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, flat[near]), len(self.keys) - 1)
        hit = self.keys[at] == flat[near]
        out[near[hit]] = self.ids[at[hit]]
        return out.reshape(keys.shape)


def _hash_text(text: str) -> int:
    codes = np.array([[ord(c) for c in text]], dtype=np.uint64)
    return int(_substrings(_sums(codes), len(text))[0, 0])


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words of ``n`` characters, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the rows' hashed characters times powers of the base."""
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(codes.shape[1], _FACTOR))), dtype=np.uint64)[: codes.shape[1]]
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _FACTOR) * up, axis=1, out=out[:, 1:])
    return out


def _substrings(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of every substring of ``length`` characters of every row."""
    n = sums.shape[1] - length
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BACK))), dtype=np.uint64)[:n]
    return mix((sums[:, length:] - sums[:, :-length]) * down + np.uint64(length))


class Segmenter:
    """Segments words; keeps the validity of piece pairs it has met (BPE), in a store of fixed size."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.pair, self.good = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        parts, owner = words, None
        if any(len(w) > LONG for w in words):
            cut = [self.cut(w) if len(w) > LONG else [w] for w in words]
            parts, owner = [x for c in cut for x in c], np.repeat(np.arange(len(words)), [len(c) for c in cut])
        lengths = np.fromiter((len(w) for w in parts), dtype=np.int64, count=len(parts))
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            n, step = int(lengths[order[a]]), max(1, (1 << 18) // max(1, int(lengths[order[a]])))
            for s in range(a, b, step) if n else ():
                own = order[s : min(b, s + step)]
                for i, ids in zip(own, self.split(_codes([parts[i] for i in own], n))):
                    found[i] = ids
        count = np.array([len(x) for x in found], dtype=np.int64)
        if owner is not None:
            count = np.bincount(owner, count, minlength=len(words)).astype(np.int64)
        return np.concatenate(found).astype(np.uint32) if found else np.zeros(0, np.uint32), count

    def cut(self, word: str) -> list[str]:
        """A long word in parts: no piece reaches over their borders, so each is segmented on its own."""
        n = len(word)
        sums = _sums(_codes([word], n))
        over = np.zeros(n + 1, dtype=np.int64)
        for length in range(2, min(n, self.p.longest) + 1):
            start = np.flatnonzero(self.p.probe(_substrings(sums, length))[0] >= 0)
            np.add.at(over, start + 1, 1)
            np.add.at(over, start + length, -1)
        at = [0, *(np.flatnonzero(np.cumsum(over)[1:n] == 0) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def split(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ids of equally long words by the Viterbi search."""
        m, n = codes.shape
        if self.p.kind == BPE and n > LONG and m <= 4:
            return [self.alone(row) for row in codes]
        p, sums = self.p, _sums(codes)
        found = []  # only lengths that occur; single characters always
        for length in range(1, min(n, p.longest) + 1):
            piece = p.probe(_substrings(sums, length))
            if length == 1 or (piece >= 0).any():
                found.append((length, piece))
        sizes = np.array([length for length, _ in found])
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((m, n + 1), -3, dtype=np.int64)  # piece that ends here; -1 a character without piece, -2 the start
        last[:, 0] = -2
        back = np.zeros((m, n + 1), dtype=np.int64)
        rows = np.arange(m)
        for end in range(1, n + 1):
            here = [(length, piece) for length, piece in found if length <= end]
            piece = np.stack([piece[:, end - length] for length, piece in here])
            before = np.stack([best[:, end - length] for length, _ in here])
            open_ = (piece >= 0) & (before > -np.inf)
            if p.kind == BPE:
                prior = np.stack([last[:, end - length] for length, _ in here])
                gain = np.where(open_, 0.0, -np.inf)
                pair = open_ & (prior >= 0)
                gain[pair] = np.where(self.pairs(prior[pair], piece[pair]), 0.0, -np.inf)
            else:
                gain = np.where(open_, p.scores[piece], -np.inf)
            total = before + gain
            total[0] = np.where((piece[0] < 0) & (before[0] > -np.inf), before[0] + (0.0 if p.kind == BPE else p.worst), total[0])
            length = np.argmax(total, axis=0)
            best[:, end], back[:, end], last[:, end] = total[length, rows], sizes[length], piece[length, rows]
        return self._walk(codes, best, last, back)

    def alone(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long word (BPE): the validity of all neighbours that can meet in it is found at once, then a plain walk goes over its places."""
        n, p = len(codes), self.p
        sums = _sums(codes[None, :])
        starts, pieces, sizes = [], [], []
        for length in range(1, min(n, p.longest) + 1):
            ids = p.probe(_substrings(sums, length))[0]
            at = np.flatnonzero(ids >= 0)
            starts.append(at)
            pieces.append(ids[at])
            sizes.append(np.full(len(at), length))
        start, piece, size = (np.concatenate(x) for x in (starts, pieces, sizes))
        order = np.argsort(start, kind="stable")
        start, piece, size = start[order], piece[order], size[order]
        first = np.searchsorted(start, np.arange(n + 2))
        end, many = start + size, len(p.pieces)
        follow = first[end + 1] - first[end]
        known: list[np.ndarray] = [np.zeros(0, np.int64)]
        total = np.cumsum(follow)
        a = 0
        while a < len(start):  # some million meetings at once
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 22), side="right")))
            own = np.repeat(np.arange(a, b), follow[a:b])
            then = np.arange(len(own)) - np.repeat(np.cumsum(follow[a:b]) - follow[a:b], follow[a:b]) + first[end[own]]
            known.append(np.unique(piece[own] * many + piece[then]))
            a = b
        pair = np.unique(np.concatenate(known))
        good = [self.pairs(*np.divmod(pair[a : a + (1 << 18)], many)) for a in range(0, len(pair), 1 << 18)]
        valid = set(pair[np.concatenate(good)].tolist()) if good else set()
        order = np.lexsort((size, end))
        last, back, at, reached = [-3] * (n + 1), [1] * (n + 1), 0, set(np.flatnonzero(p.probe(_substrings(sums, 1))[0] < 0).tolist())
        last[0] = -2
        edges = list(zip(start[order].tolist(), end[order].tolist(), piece[order].tolist()))
        for e in range(1, n + 1):
            if e - 1 in reached and last[e - 1] != -3:
                last[e] = -1  # a character without piece
            while at < len(edges) and edges[at][1] == e:
                s, _, x = edges[at]
                before = last[s]
                if last[e] == -3 and before != -3 and (before < 0 or before * many + x in valid):
                    last[e], back[e] = x, e - s
                at += 1
        if last[n] == -3:
            return self._merged(codes)
        out, e = [], n
        while e:
            out.append([last[e]] if last[e] >= 0 else self.bare(chr(int(codes[e - 1]))))
            e -= back[e]
        return np.array([x for ids in reversed(out) for x in ids], dtype=np.int64)

    def _walk(self, codes, best, last, back) -> list[np.ndarray]:
        m, n = codes.shape
        steps = np.zeros((m, n + 1), dtype=bool)
        at, rows = np.full(m, n), np.arange(m)
        while len(rows):
            steps[rows, at[rows]] = True
            at[rows] -= np.maximum(back[rows, at[rows]], 1)
            rows = rows[at[rows] > 0]
        out = []
        lost = np.isneginf(best[:, n])
        plain = ((last >= 0) | ~steps)[:, 1:].all(axis=1) & ~lost
        for i in range(m):
            if plain[i]:
                out.append(last[i, 1:][steps[i, 1:]])
            elif lost[i]:
                out.append(self._merged(codes[i]))
            else:
                out.append(np.concatenate([[x] if x >= 0 else self.bare(chr(int(codes[i, e - 1]))) for e, x in enumerate(last[i]) if e and steps[i, e]]).astype(np.int64))
        return out

    def bare(self, c: str) -> list[int]:
        """Ids of a character without piece: its bytes, or the unknown piece."""
        return [self.p.unknown] if self.p.bytes_at is None else [self.p.bytes_at + b for b in c.encode("utf-8", "replace")]

    def _merged(self, codes: np.ndarray) -> np.ndarray:
        ids, lengths, _ = merge_by_rank(self.p, codes[None, :])
        out, at = [], 0
        for x, k in zip(ids[0], lengths[0]):
            if k:
                out += [int(x)] if x >= 0 else self.bare(chr(int(codes[at])))
                at += int(k)
        return np.array(out, dtype=np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces by rank gives these two."""
        keys = a * len(self.p.pieces) + b
        slot = (mix(keys.astype(np.uint64)) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)
        out = self.good[slot]
        new = np.flatnonzero(self.pair[slot] != keys)
        if len(new):
            names, first, at = np.unique(keys[new], return_index=True, return_inverse=True)
            good = self.p.neighbours(*np.divmod(names, len(self.p.pieces)))
            out[new] = good[at]
            self.pair[slot[new[first]]], self.good[slot[new[first]]] = names, good
        return out


def merge_by_rank(p: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge equally long texts: again and again the adjacent pair whose joined piece scores highest, the leftmost of equals.

    Returns, for each position, the id of the piece that starts there (-1: a character without piece) and its length (0: none starts there); and the
    two pieces of each text's last merge.
    """
    m, n = codes.shape
    sums = _sums(codes)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BACK))), dtype=np.uint64)
    rows = np.arange(m)

    def joined(r, start, end):
        return p.probe(mix((sums[r, end] - sums[r, start]) * down[start] + (end - start).astype(np.uint64)))

    ids = np.stack([joined(rows, np.full(m, i), np.full(m, i + 1)) for i in range(n)], axis=1)
    length = np.ones((m, n), dtype=np.int64)
    before = np.tile(np.arange(n) - 1, (m, 1))
    made = np.full((m, n), -1, dtype=np.int64)  # piece of this symbol joined with the next
    for i in range(n - 1):
        made[:, i] = joined(rows, np.full(m, i), np.full(m, i + 2))
    worth = np.where(made >= 0, p.scores[made], -np.inf)
    last = np.zeros((m, 2), dtype=np.int64)
    while len(rows):
        at = np.argmax(worth[rows], axis=1)
        go = worth[rows, at] > -np.inf
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        nxt = at + length[rows, at]
        last[rows, 0], last[rows, 1] = ids[rows, at], ids[rows, nxt]
        ids[rows, at] = made[rows, at]
        length[rows, at] += length[rows, nxt]
        length[rows, nxt] = 0
        worth[rows, nxt] = -np.inf
        after = at + length[rows, at]
        more = after < n
        before[rows[more], after[more]] = at[more]
        for r, start in ((rows, at), (rows[before[rows, at] >= 0], before[rows, at][before[rows, at] >= 0])):
            mid = start + length[r, start]
            ok = mid < n
            made[r, start], worth[r, start] = -1, -np.inf
            r, start, mid = r[ok], start[ok], mid[ok]
            piece = joined(r, start, mid + length[r, mid])
            made[r, start] = piece
            worth[r, start] = np.where(piece >= 0, p.scores[piece], -np.inf)
    return np.where(length > 0, ids, -2), length, last


class Encoder:
    """Texts to ids and back, for the slices of a task."""

    def __init__(self, pieces: Pieces):
        self.p, self.segment = pieces, Segmenter(pieces)
        self.store, self.hasher = WordStore(CACHED_WORDS), WordHasher(fold=False)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each begins."""
        lead = b" " if self.p.prefix else b""
        texts = [lead + t.replace(SPACE.encode(), b" ") if t else t for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = raw == 32
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[: len(raw)])
        ends = np.append(starts[1:], len(raw))
        first = np.searchsorted(starts, offsets)
        words = lambda new: self.segment([w.replace(" ", SPACE) for w in new])
        return self.store.gather(self.store.rows(self.hasher.of(raw, starts, ends), raw, starts, ends, words), first)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of id sequences; the space that encoding puts in front is taken off."""
        ids = ids.astype(np.int64)
        size = np.diff(self.p.out_at)[ids]
        end = np.concatenate(([0], np.cumsum(size)))
        data = self.p.out[np.repeat(self.p.out_at[ids] - end[:-1], size) + np.arange(end[-1])].tobytes() if len(ids) else b""
        parts = [data[a:b] for a, b in zip(end[first[:-1]], end[first[1:]])]
        return [(x[1:] if self.p.prefix and x[:1] == b" " else x).decode("utf-8", "replace") for x in parts]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``ids``, ``decoded`` (the ids turned back) and ``round_trip`` (whether that is the text; the space sign itself is read as a space).

    NULL and empty texts have no ids. NULL keys and repeated rows pass through; other columns are left out.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    model, token = docs.sparkSession.sparkContext.broadcast(Pieces.load(path)), uuid.uuid4().hex

    def run(batches):
        coder = kept("pieces", token, lambda: Encoder(model.value))
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1), ENCODE_BYTES):
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(offsets, offsets[1:])]
                ids, first = coder.encode(texts)
                back = coder.decode(ids, first)
                same = [x.encode() == t.replace(SPACE.encode(), b" ") for x, t in zip(back, texts)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), lists, pa.array(back, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "decoded", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string, round_trip boolean")


def digest(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (over the ids as 32-bit little-endian numbers), ``n_decoded`` characters and ``round_trip``."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), batch.column("n_decoded"), batch.column("round_trip")], names=["doc_id", "n_ids", "ids_crc32", "n_decoded", "round_trip"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    short = encoded.select("doc_id", "ids", F.length("decoded").cast("long").alias("n_decoded"), "round_trip")
    return short.mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_decoded long, round_trip boolean")
