"""Prefix trie of conversations: z-fast tries of sorted chunks, joined at their borders.

A conversation is the sequence of its turns. Turns become 16-byte digests when read, and the digest of a prefix is that of the prefix before
it and the new turn, so a prefix of any depth is known by 16 bytes and texts never travel.

Conversations are range-partitioned by their prefix digests, so those that share prefixes stand together and a first turn that a third
of them share simply spans many partitions. Every task puts its rows, in chunks of bounded size, into a :class:`ZFastTrie`: compacted nodes are
hashed under the prefix at their two-fattest depth, a batch of conversations finds its exit nodes by fat binary search, edges split and
grow. The edges are then expanded to one row per depth. Counts of a chunk are sums, so only nodes that neighbouring chunks share (the
prefixes of a chunk's first and last conversation) are added up by a shuffle. Where two partitions meet, what both counted is taken
off once, from one summary row a partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegauge.llm.common import ready
from truegauge.session import materialise

#: Conversations, and bytes of their prefix digests, that one in-memory trie takes.
CHUNK_ROWS, CHUNK_BYTES = 8192, 8 << 20
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the greatest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def shared_depth(a: bytes, b: bytes, low: int = 0) -> int:
    """Depth down to which two paths agree (prefix digests agree at all depths above one at which they do)."""
    high = min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[WIDTH * (mid - 1) : WIDTH * mid] == b[WIDTH * (mid - 1) : WIDTH * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class ZFastTrie:
    """Compacted trie over paths (the digests of all prefixes of a sequence, one behind another). Node 0 is the root.

    A node stands for the stretch of depths (``depth`` of its parent, own ``depth``]; ``handles`` finds it by the prefix at the two-fattest depth of
    that stretch, ``first`` by the prefix at its top.
    """

    def __init__(self):
        self.path: list[bytes] = [b""]
        self.depth, self.parent = [0], [-1]
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}

    def locate(self, path: bytes) -> tuple[int, int]:
        """Exit node of a path, and the depth down to which the path agrees with it."""
        low, high, node = 0, len(path) // WIDTH, 0
        while low < high:
            at = fattest(low, high)
            hit = self.handles.get(path[WIDTH * (at - 1) : WIDTH * at])
            if hit is None:
                high = at - 1
                continue
            end = WIDTH * self.depth[hit]
            if end > len(path) or path[end - WIDTH : end] != self.path[hit][end - WIDTH : end]:
                return hit, shared_depth(path, self.path[hit][:end], at)
            low, node = self.depth[hit], hit
        # The exit node is this one or a child whose handle lies below where the path leaves it.
        below = self.first.get(path[WIDTH * low : WIDTH * (low + 1)]) if WIDTH * low < len(path) else None
        if below is None:
            return node, low
        return below, shared_depth(path, self.path[below][: WIDTH * self.depth[below]], low + 1)

    def _place(self, node: int, parent: int) -> None:
        """Hang ``node`` under ``parent`` and hash it."""
        path, top, end = self.path[node], self.depth[parent], self.depth[node]
        self.parent[node] = parent
        at = fattest(top, end)
        self.handles[path[WIDTH * (at - 1) : WIDTH * at]] = node
        self.first[path[WIDTH * top : WIDTH * (top + 1)]] = node

    def _new(self, path: bytes, depth: int, parent: int) -> int:
        self.path.append(path)
        self.depth.append(depth)
        self.parent.append(parent)
        self._place(len(self.path) - 1, parent)
        return len(self.path) - 1

    def insert(self, path: bytes) -> int:
        """Node at which the path ends."""
        node, agree = self.locate(path)
        if agree < self.depth[node]:
            # The old handle stays right for one of the halves and is set anew for it.
            upper = self._new(self.path[node], agree, self.parent[node])
            self._place(node, upper)
            node = upper
        return node if agree == len(path) // WIDTH else self._new(path, len(path) // WIDTH, node)

    def insert_batch(self, paths: list[bytes]) -> list[int]:
        """Ends of a batch; a path equal to the one before it isn't searched again."""
        out, before, node = [], None, 0
        for path in paths:
            if path != before:
                before, node = path, self.insert(path)
            out.append(node)
        return out


def _expand(paths: list[bytes], sizes: list[bytes], ids: list[int], prev: bytes | None, then: bytes | None) -> dict[str, list]:
    """Rows of all nodes of one sorted chunk. ``prev`` and ``then`` are the conversations before and behind it in the partition, None at its ends.

    Nodes on the path of ``prev`` were counted before: they don't add to children and savings again. Nodes that a neighbour may have too are marked ``shared``.
    """
    trie = ZFastTrie()
    ends = trie.insert_batch(paths)
    n = len(trie.path)
    count, least, leaves, saved, kids = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    own: list[list[int]] = [[] for _ in range(n)]
    for i, node in zip(ids, ends):
        own[node].append(i)
    by_path = {path: size for path, size in zip(paths, sizes)}
    cut = lambda path, depth: [path[WIDTH * (d - 1) : WIDTH * d] for d in range(1, depth + 1)]
    first, last = paths[0], paths[-1]
    before = -1 if prev is None else shared_depth(prev, first)
    seen = set(cut(first, max(before, 0)))
    shared = set(cut(first, len(first) // WIDTH if prev is None else before)) | set(cut(last, len(last) // WIDTH if then is None else shared_depth(last, then)))
    open_leaf = ends[-1] if then is not None and then[: len(last)] == last else -1
    has_child = [False] * n
    for p in trie.parent[1:]:
        has_child[p] = True
    rows: dict[str, list] = {k: [] for k in ("id", "parent", "depth", "conv_id", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "first_end", "shared")}
    add = [rows[k].append for k in rows]
    hang: list[tuple[int, int]] = []
    for v in sorted(range(n), key=lambda v: -trie.depth[v]):
        p, path = trie.parent[v], trie.path[v]
        top = trie.depth[p] if v else 0
        if own[v]:
            count[v] += len(own[v])
            least[v] = min(own[v][0], least[v]) if least[v] is not None else own[v][0]
        if not has_child[v] and v != open_leaf:
            leaves[v] += 1
        m, low, leaf, save, kid = count[v], least[v], leaves[v], saved[v], kids[v]
        length = np.frombuffer(by_path[path], np.int64).tolist() if path in by_path and v else []
        text = ",".join(map(str, own[v])) if own[v] else None
        for d in range(trie.depth[v], top, -1):
            me, up = path[WIDTH * (d - 1) : WIDTH * d], path[WIDTH * (d - 2) : WIDTH * (d - 1)] if d > 1 else b""
            fresh = me not in seen
            save += (m - fresh) * length[d - 1]
            both = me in shared
            above = up in shared or d == 1
            sha = None if both else hashlib.sha256(text.encode()).hexdigest() if text else NO_ENDS
            if d == top + 1 and not above:
                hang.append((len(rows["id"]), p))
            for put, x in zip(add, (me, up, d, low, None if above else low, m, kid, leaf, save, text if both else sha, own[v][0] if both and text else None, both)):
                put(x)
            kid, text = int(fresh), None
        if v:
            count[p] += m
            least[p] = low if least[p] is None else min(least[p], low)
            leaves[p] += leaf
            saved[p] += save
            kids[p] += kid
        else:
            for put, x in zip(add, (b"", None, 0, low, None, m, kid, leaf, save, text, own[v][0] if text else None, True)):
                put(x)
    for row, p in hang:
        rows["parent_conv"][row] = least[p]
    return rows


NODE = "id binary, parent binary, depth long, conv_id long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, first_end long, shared boolean"
SUMMARY = "part int, head binary, head_sizes binary, tail binary"
_TYPES = [
    *[(k, pa.binary()) for k in ("id", "parent")], *[(k, pa.int64()) for k in ("depth", "conv_id", "parent_conv", "n_convs", "n_children", "n_leaves", "saved")],
    ("ends", pa.string()), ("first_end", pa.int64()), ("shared", pa.bool_()), ("part", pa.int32()), *[(k, pa.binary()) for k in ("head", "head_sizes", "tail")],
]
_ALL = pa.schema(_TYPES)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(rows.values())))
    return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * n), f.type) for f in _ALL], schema=_ALL)


def _tries(batches, chunk: int = CHUNK_ROWS):
    """Sorted rows (part, conv_id, path, sizes) of one partition to node rows, and one summary row."""
    paths, sizes, ids, held, prev, part, head = [], [], [], 0, None, None, None
    for batch in batches:
        for part, i, path, size in zip(*[c.to_pylist() for c in batch.columns]):
            if head is None:
                head = (path, size)
            if len(paths) >= chunk or held >= CHUNK_BYTES:
                yield _batch(_expand(paths, sizes, ids, prev, path))
                paths, sizes, ids, held, prev = [], [], [], 0, paths[-1]
            paths.append(path)
            sizes.append(size)
            ids.append(i)
            held += len(path)
    if paths:
        yield _batch(_expand(paths, sizes, ids, prev, None))
        yield _batch({"part": [part], "head": [head[0]], "head_sizes": [head[1]], "tail": [paths[-1]]})


def _corrections(batches):
    """What two neighbouring partitions both counted, from rows (head, head_sizes, tail of the one before)."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("id", "n_children", "n_leaves", "saved")}
        for head, size, tail in zip(*[c.to_pylist() for c in batch.columns]):
            depth = shared_depth(head, tail)
            length = np.frombuffer(size, np.int64).tolist()
            again = -int(len(tail) == WIDTH * depth)  # the tail ended there and was taken for a leaf
            back = 0
            for d in range(depth, -1, -1):
                back += length[d - 1] if d else 0
                for k, x in zip(rows, (head[WIDTH * (d - 1) : WIDTH * d] if d else b"", -int(d < depth), again, back)):
                    rows[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.binary()), *[pa.array(rows[k], pa.int64()) for k in list(rows)[1:]]], names=list(rows))


def _hashes(batches):
    """Rows (id, list of numbers) sorted by id to one checksum per id, piece by piece."""
    last, state = None, None
    for batch in batches:
        ids, shas = [], []
        for i, text in zip(*[c.to_pylist() for c in batch.columns]):
            if i != last:
                if state is not None:
                    ids.append(last)
                    shas.append(state.hexdigest())
                last, state = i, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shas, pa.string())], names=["id", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["id", "sha"])


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(block, conv_id, turns): per conversation its turns in order, as (digest of role and text, UTF-8 bytes of the text).

    ``block`` is the conversation's number less its remainder by five; the rows of a block lie together. Turns are ordered by ``turn``, NULL first,
    equal ones by their digest. NULL roles and texts are empty. Rows without conversation belong to none and are left out. A
    conversation's digests, 24 bytes a turn, are held in one row; its texts are not.
    """
    ready(conversations.sparkSession)
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    c = F.col(conv).cast("long")
    turns = conversations.where(c.isNotNull()).select(
        (c - F.pmod(c, F.lit(5))).alias("block"), c.alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"))).alias("digest"), F.octet_length(t).cast("long").alias("size"),
    )
    row = F.struct("turn", "digest", "size")
    return turns.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns")).select(
        "block", "conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns")
    )


def rebuilt(found: DataFrame) -> DataFrame:
    """:func:`sequences` with the first ``h`` turns of each replaced by the first ``h`` of its block's first number (all it has; none if
    that is absent), ``h`` the checksum of its number by nine."""
    heads = found.where("conv_id = block").select("block", F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rest = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    front = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return found.join(heads, "block", "left").select("block", "conv_id", F.concat(front, rest).alias("turns"))


def trie_nodes(found: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """One row per distinct prefix of the :func:`sequences`: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes of last turns that members share, over the subtree), ``ends_sha256`` (checksum of the sorted members that end there). ``chunk``
    conversations go into one trie in memory; the result doesn't depend on it.

    No conversation gives no row, not even the root; conversations without turns end at the root. Copies are members like others: equal
    conversations are one path, and one that very many end at is a list in pieces over many chunks, whose checksum one task computes as a
    stream (it can't be split).
    """
    ready(found.sparkSession)

    def chain(batches):
        for batch in batches:
            paths, sizes = [], []
            for turns in batch.column(1).to_pylist():
                at, path = b"", []
                for t in turns:
                    at = hashlib.blake2b(at + t["digest"], digest_size=WIDTH).digest()
                    path.append(at)
                paths.append(b"".join(path))
                sizes.append(np.array([t["size"] for t in turns], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(sizes, pa.binary())], names=["conv_id", "path", "sizes"])

    paths = found.select("conv_id", "turns").mapInArrow(chain, "conv_id long, path binary, sizes binary")
    laid = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "path", "sizes")
    made = materialise(laid.mapInArrow(lambda batches: _tries(batches, chunk), f"{NODE}, {SUMMARY}"), "trie")
    nodes = made.where("depth is not null").select(*[c.split()[0] for c in NODE.split(", ")])

    # One row a partition: what it shares with the one before.
    border = made.where("part is not null").select("part", "head", "head_sizes", "tail")
    border = border.select("head", "head_sizes", F.lag("tail").over(Window.orderBy("part")).alias("tail")).where("tail is not null")
    off = border.mapInArrow(_corrections, "id binary, n_children long, n_leaves long, saved long")

    parts = nodes.where("shared")
    ends = parts.where("ends is not null").select("id", "ends", "first_end").repartition("id").sortWithinPartitions("id", "first_end")
    ends = ends.select("id", "ends").mapInArrow(_hashes, "id binary, sha string")
    total = parts.select("id", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved").unionByName(off, allowMissingColumns=True).groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    total = materialise(total.join(ends, "id", "left").withColumn("ends", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"), "shared")

    columns = ["conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    inner = nodes.where("not shared and parent_conv is not null").select(*columns)
    above = total.select(F.col("id").alias("_up"), F.col("conv_id").alias("parent_conv"))
    open_ = nodes.where("not shared and parent_conv is null").drop("parent_conv", "shared", "first_end").unionByName(total)
    return inner.unionByName(open_.join(above, F.col("parent") == F.col("_up"), "left").select(*columns))
