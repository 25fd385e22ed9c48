"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, by adaptive multi-match prefixes.

All tokens (48-bit n-gram hashes, so that six bytes are stored for each) have one global order, rare ones first: by the counts of their words, which stay telling however large the table is, and by a count of
their own, as far as it stands out among the counters of fixed number. Any order gives the same result; a good one gives fewer candidates. Two sets that are similar enough share a token among
their first ``n - ceil(t n) + 1`` ones (the base prefix), and ``l`` tokens among the first ``n - ceil(t n) + l``. A document whose base
prefix leads to many candidates gets a larger ``l``: a longer prefix, and more tokens that must match before a pair is verified.

The result is one row per document with its link class, so pairs that are already known to be connected are not looked at again:

1. Equal sets collapse into one node (the first row of a set in a task keeps its tokens, others only their set's key).
2. Every list of nodes that share a base prefix token gets a hub, the member with most shared tokens; hub pairs are verified,
   which is linear in the lists' sizes.
3. Only lists that still hold more than one class go on. A list is dealt in chunks of bounded size, the members of its largest class
   in chunks of their own. Every pair of chunks but those inside that class is one block, and a block counts matches and verifies
   inside the task, emitting at most one link for each document.

Pairs whose sizes rule a link out are dropped before any prefix moves, and only nodes that a fixed-size bitmap names bring theirs.

No pair is dropped: lists have no cap, and a hot list only means more blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, bitmap_of, free_name, in_bitmap, ready, run_shingles, small, text_slices
from truegauge.llm.components import components
from truegauge.session import discard, materialise

#: log2 of the numbers of counters behind the global order (of words, of tokens), and counters in one shuffled row.
WORD_BITS = 20
COUNTER_BITS = 23
SLAB = 1 << 16
#: Lists of up to so many members are joined pair by pair, longer ones go through blocks.
COLD = 32
#: Most tokens beyond the base prefix that a document's prefix may be lengthened by.
LONGEST = 7
#: Documents of one chunk of a token's list.
CHUNK = 192
#: The bits of a hash that make a token.
HIGH = np.uint64(0xFFFFFFFFFFFF0000)
#: log2 of the bits of the bitmap that preselects token sets.
SET_BITS = 25
#: log2 of the bits of the bitmap that preselects shared tokens.
TOKEN_BITS = 25


def _token_sets(k: int, words):
    """Batches of (doc_id, text) to (doc_id, same, key, n, tokens, weights); ``same`` tells texts apart, tokens and what their words weigh come only
    at a set's first row in the task."""

    def run(batches):
        seen, hasher = set(), WordHasher()
        for batch in batches:
            ids = batch.column(0)
            for row, raw, offsets in text_slices(batch.column(1)):
                hashes, begin = hasher(raw, offsets)
                got, first = run_shingles(hashes, begin, k)
                sums = np.concatenate(([0], np.cumsum(words.value[_counter(hashes, WORD_BITS)].astype(np.int64))))
                same, keys, sizes, tokens, weights = [], [], [], [], []
                for i in range(len(offsets) - 1):
                    own, at = np.unique(got[first[i] : first[i + 1]] & HIGH, return_index=True)
                    data = _pack(own)
                    key = hashlib.md5(data).digest()
                    new = len(own) and key not in seen
                    seen.add(key)
                    same.append(hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest())
                    keys.append(key)
                    sizes.append(len(own))
                    tokens.append(data if new else None)
                    width = min(k, begin[i + 1] - begin[i])
                    weights.append(((sums[begin[i] + at + width] - sums[begin[i] + at]) // max(width, 1)).astype(np.uint8).tobytes() if new else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(keys)), pa.array(same, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(weights, pa.binary())],
                    names=["doc_id", "same", "key", "n", "tokens", "weights"],
                )

    return run


def _pack(tokens: np.ndarray) -> bytes:
    """The six high bytes of each token; order stays."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(data) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, 2:] = short
    return out.view(np.uint64).ravel()


def _fingers(tokens: np.ndarray) -> bytes:
    """Four bytes of each token, for counting matches."""
    return (tokens.view(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes()


def _numbered(data) -> np.ndarray:
    """The numbers of :func:`_fingers`, those that come again with how often they came before: sets share at least as many of them as tokens."""
    out = np.frombuffer(data, np.uint32).astype(np.int64)
    by = np.argsort(out, kind="stable")
    same = np.concatenate(([False], out[by[1:]] == out[by[:-1]]))
    if same.any():
        place = np.arange(len(out))
        out[by] += (place - np.maximum.accumulate(np.where(same, 0, place))) << 32
    return out


def _counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _token_hashes(batches):
    for batch in batches:
        yield _unpack(b"".join(x for x in batch.column(0).to_pylist() if x is not None))


def _text_hashes(batches):
    hasher = WordHasher()
    for batch in batches:
        for _, raw, offsets in text_slices(batch.column(0)):
            yield hasher(raw, offsets)[0]


def _count_task(hashes, bits: int):
    """Hashes of a task, counted in ``2 ** bits`` counters: one row for each slab of counters that isn't empty."""

    def run(batches):
        total = np.zeros(1 << bits, dtype=np.uint32)
        for own in hashes(batches):
            np.add.at(total, _counter(own, bits), np.uint32(1))
        for slab in range(0, len(total), SLAB):
            part = total[slab : slab + SLAB]
            where = np.flatnonzero(part)
            if len(where):
                gaps, counts = _narrow(np.diff(where, prepend=0)), _narrow(part[where])
                yield pa.RecordBatch.from_pylist([{"slab": slab // SLAB, "n": len(where), "gaps": gaps.tobytes(), "counts": counts.tobytes()}])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())))


def _widen(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`_narrow`."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _merge_slabs(batches):
    """Sums of the slabs that came to this task, on a logarithmic scale of one byte."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, n, gaps, counts in zip(*(c.to_pylist() for c in batch.columns)):
            mine = total.setdefault(slab, np.zeros(SLAB, dtype=np.int64))
            mine[np.cumsum(_widen(gaps, n))] += _widen(counts, n)
    for slab, part in total.items():
        yield pa.RecordBatch.from_pylist([{"slab": slab, "weights": np.minimum(STEPS * np.log2(1 + part), 255).astype(np.uint8).tobytes()}])


#: Steps of the logarithmic scale for a doubling.
STEPS = 6


def _global_counts(rows: DataFrame, hashes, bits: int) -> np.ndarray:
    """Weights of all counters, one byte each, whatever the input's size."""
    slabs = "slab long, n long, gaps binary, counts binary"
    merged = rows.mapInArrow(_count_task(hashes, bits), slabs).repartition(max(1, 1 << (bits - 18)), "slab").mapInArrow(_merge_slabs, "slab long, weights binary")
    total = np.zeros(1 << bits, dtype=np.uint8)
    for slab, weights in merged.collect():
        total[slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(weights, np.uint8)
    return total


def _least(n, percent: int):
    """Smallest overlap that a set of ``n`` tokens needs with any partner."""
    return (n * percent + 99) // 100


def _prefixes(order, percent: int):
    """(rid, n, tokens, weights) to (rid, n, prefix): the first tokens in the global order, ``LONGEST`` beyond the base prefix."""

    def run(batches):
        counts, usual = order.value
        for batch in batches:
            out = []
            for n, data, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = _unpack(data)
                most = min(n, n - _least(n, percent) + 1 + LONGEST)
                hot = counts[_counter(own, COUNTER_BITS)].astype(np.int64) - usual
                weight = np.frombuffer(words, np.uint8) + 10 * np.maximum(hot, 0)
                if most < n:
                    near = weight <= np.partition(weight, most - 1)[most - 1]
                    own, weight = own[near], weight[near]
                out.append(own[np.lexsort((own, weight))][:most].view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], names=["rid", "n", "prefix"]
            )

    return run


def _pair_filter(percent: int):
    """Links among sets: ``100 * overlap >= percent * union``, in whole numbers."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a_tokens"), batch.column("b_tokens")
            keep = []
            for x, y in zip(a, b):
                x, y = _unpack(x.as_buffer()), _unpack(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links (a, b) among ``n`` members, those that first connect two parts."""
    parent, out = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x_, y_ = root(x), root(y)
        if x_ != y_:
            parent[x_] = y_
            out.append((x, y))
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets, over the tokens that at least two of them hold, a strip of tokens at a time."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    rows, place = rows[keep], number[place[keep]]
    by = np.argsort(place, kind="stable")
    rows, place = rows[by], place[by]
    out = np.zeros((m, m), dtype=np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(place, (start, start + 2048))
        strip = np.zeros((m, 2048), dtype=np.float32)
        strip[rows[a:b], place[a:b] - start] = 1
        out += strip @ strip.T
    return out.astype(np.int64)


def block_pairs(labels, levels, prefixes, sizes, sides, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block whose classes differ, whose sizes allow a link, and whose lengthened prefixes share as many tokens as the smaller of the two
    levels asks for. ``sides`` are 0 or 1 when only pairs across the two chunks belong to this block, all 0 when it is one chunk.
    """
    labels, sides, sizes = np.asarray(labels), np.asarray(sides), np.asarray(sizes)
    least = _least(sizes, percent)
    level = np.minimum(np.asarray(levels), np.maximum(least, 1))
    a, b = np.triu_indices(len(sizes), 1)
    fit = (labels[a] != labels[b]) & ((sides[a] != sides[b]) | (not sides.any()))
    fit &= 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    a, b = a[fit], b[fit]
    need = np.minimum(level[a], level[b])
    match = np.zeros(len(a), dtype=np.int64)
    for want in np.unique(need):
        at = need == want
        shared = _overlaps([p[: n - s + want] for p, n, s in zip(prefixes, sizes, least)])
        match[at] = shared[a[at], b[at]]
    return a[match >= need], b[match >= need]


def block_links(nodes, labels, levels, prefixes, sets, sides, percent: int) -> list[tuple[int, int]]:
    """Links of one block between documents of different classes, at most one for each document."""
    sizes = np.array([len(s) for s in sets])
    a, b = block_pairs(labels, levels, prefixes, sizes, sides, percent)
    if not len(a):
        return []
    both = _overlaps(sets)[a, b] if len(a) > len(sets) else np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    linked = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    return [(nodes[x], nodes[y]) for x, y in _forest(a[linked], b[linked], len(sets))]


def _blocks(percent: int, whole: bool):
    """Rows sorted by block (token, low, high); one block is held at a time. With whole sets the block's links, else (token, node) of the
    members that have a matching partner in it."""

    def one(rows):
        cols = list(zip(*rows))
        prefixes = [_numbered(x) for x in cols[7]]
        sides = [int(low != high and chunk == high) for low, high, chunk in zip(cols[1], cols[2], cols[3])]
        if whole:
            return block_links(cols[4], cols[5], cols[6], prefixes, [_unpack(x) for x in cols[8]], sides, percent)
        a, b = block_pairs(cols[5], cols[6], prefixes, cols[8], sides, percent)
        return [(cols[0][i], cols[4][i]) for i in np.unique(np.concatenate((a, b)))]

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    out += one(held) if len(held) > 1 else []
                    key, held = row[:3], []
                held.append(row)
            if out:
                yield _links_batch(out)
        if len(held) > 1 and (out := one(held)):
            yield _links_batch(out)

    return run


def _links_batch(links) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _preselect(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (rid first) of the wanted nodes and a few others: a bitmap of fixed size keeps most rows out of the joins to come."""
    return _sieve(rows, rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "rid", SET_BITS)), True)


def _sieve(rows: DataFrame, bits, named: bool) -> DataFrame:
    """The rows (rid first) whose rid the bitmap names, or those whose rid it doesn't."""

    def run(batches):
        for batch in batches:
            keep = in_bitmap(bits.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), SET_BITS) == named
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _only_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rid, n, tokens, weights) of the nodes. Rows whose set another task has too are told by a bitmap; the nodes that it names by mistake are joined."""
    rows = sets.where("tokens is not null").select("rid", "n", "tokens", "weights")
    bits = sets.sparkSession.sparkContext.broadcast(bitmap_of(rows.select("rid").join(nodes, "rid", "left_anti"), "rid", SET_BITS))
    sure, mistaken = _sieve(rows, bits, False), materialise(_sieve(nodes, bits, True), "mistaken")
    return sure if mistaken.isEmpty() else sure.unionByName(_preselect(rows, mistaken).join(mistaken, "rid"))


def _fetch(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, tokens) of the wanted nodes and a few others."""
    return _preselect(sets.where("tokens is not null").select("rid", "tokens"), wanted)


def _near_sizes(a: str, b: str, percent: int):
    """Whether sets of these sizes can be a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _listed(prefixes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(rid, n, token, s) of the base prefixes for the shared tokens and a few others, told by a bitmap of fixed size; ``s`` is how many the row has."""
    bits = prefixes.sparkSession.sparkContext.broadcast(bitmap_of(shared, "token", TOKEN_BITS))

    def run(batches):
        for batch in batches:
            rid, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            tokens, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(rid)), np.diff(first))
            tokens = tokens[first[0] : first[-1]]
            inner = np.arange(len(tokens)) + first[0] - first[owner]
            keep = (inner <= n[owner] - _least(n[owner], percent)) & in_bitmap(bits.value, tokens.view(np.uint64), TOKEN_BITS)
            s = np.bincount(owner[keep], minlength=len(rid))
            columns = (rid[owner[keep]], n[owner[keep]], tokens[keep], s[owner[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["rid", "n", "token", "s"])

    return prefixes.select("rid", "n", "prefix").mapInArrow(run, "rid long, n long, token long, s long")


def _fingered(batches):
    """(rid, n, prefix) with four bytes a token."""
    for batch in batches:
        lists = batch.column(2)
        flat, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        data = pa.array([_fingers(flat[a:b]) for a, b in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["rid", "n", "prefix"])


def link_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Words are runs without ASCII white space, A-Z folded. A document's set holds its distinct ``words``-grams, or its whole sequence if it
    is shorter. NULL and empty texts have an empty set, link with nothing and keep their own key as class. Rows with equal keys are
    separate rows; equal sets are always in one class. A NULL key is a class id only if the class has no other. Other columns of
    ``docs`` are ignored. An empty table gives an empty table.
    """
    return _classes(docs, key, text, words, percent)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with their classes, and the scratch tables that are read for them."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(_global_counts(rows.select("text"), _text_hashes, WORD_BITS))
    sets = rows.mapInArrow(_token_sets(words, weights), "doc_id long, same binary, key binary, n long, tokens binary, weights binary")
    sets = materialise(sets.withColumn("rid", F.monotonically_increasing_id()), "sets")
    classes = sets.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min(F.when(F.col("tokens").isNotNull(), F.col("rid"))).alias("node")
    )
    classes = materialise(classes, "classes")
    links = _links(spark, sets, classes.select(F.col("node").alias("rid")), percent)
    label = components(links)
    named = classes.join(label, classes["node"] == label["id"], "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_key = named.join(smallest, "label").select("key", "label", "component_id")
    full = sets.where("n > 0").select("doc_id", "same", "key", "n").join(by_key, "key").select("doc_id", "same", "n", "label", "component_id")
    none = sets.where("n = 0").select("doc_id", "same", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none), [sets, classes]


def _links(spark, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of node ids that connect whatever is connected by all links."""
    counts = _global_counts(sets.where("tokens is not null").select("tokens"), _token_hashes, COUNTER_BITS)
    # A counter that says no more than the average of all says nothing of its tokens.
    usual = int(STEPS * np.log2(2 + np.mean(np.exp2(counts / np.float32(STEPS)) - 1)))
    order = spark.sparkContext.broadcast((counts, usual))
    prefixes = materialise(_only_nodes(sets, nodes).mapInArrow(_prefixes(order, percent), "rid long, n long, prefix array<long>"), "prefixes")
    base = F.slice("prefix", 1, (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("int"))
    posted = prefixes.select("rid", F.explode(base).alias("token"))
    shared = materialise(posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    # The hub is known as soon as the lists are counted, so the lists move once.
    posted = _listed(prefixes, shared, percent)
    hubs = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("s", (-F.col("rid")).alias("h"), "n")).alias("top")).where("c > 1")
    hubs = hubs.select("token", "c", (-F.col("top.h")).alias("hub"), F.col("top.n").alias("hub_n"))
    listed = materialise(posted.drop("s").join(hubs, "token"), "listed")
    known = materialise(_preselect(prefixes, listed.select("rid")).mapInArrow(_fingered, "rid long, n long, prefix binary"), "known")
    discard(prefixes, shared)
    cost = listed.groupBy("rid").agg(F.sum("c").alias("cost"))
    level = F.least(F.lit(1 + LONGEST), F.ceil(F.log2("cost"))).cast("long")
    levels = materialise(cost.select("rid", level.alias("level")), "levels")
    pairs = listed.where(F.col("hub") != F.col("rid")).where(_near_sizes("n", "hub_n", percent))
    pairs = pairs.select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    first = _verify(sets, _matching(pairs, known, levels, percent), percent)
    label = components(first)
    # Lists whose members are of one class already can't change the result.
    marked = listed.select("rid", "n", "token", "c").join(label.select(F.col("id").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    marked = materialise(marked, "marked")
    discard(listed)
    # Lists with the same members make the same pairs, so one of them is enough (members compared by two 64-bit sums).
    members = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.hash("rid").cast("long")).alias("y")]
    open_ = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *members).where("lo <> hi")
    open_ = open_.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
    left = materialise(marked.join(open_, "token"), "open")
    discard(marked)
    cold = left.where(F.col("c") <= COLD).select("token", "rid", "n", "label")
    other = cold.select("token", F.col("rid").alias("b"), F.col("n").alias("b_n"), F.col("label").alias("other"))
    pairs = cold.join(other, "token").where("rid < b and label <> other").where(_near_sizes("n", "b_n", percent))
    pairs = pairs.select(F.col("rid").alias("a"), "b").distinct()
    second = _verify(sets, _matching(pairs, known, levels, percent), percent)
    third = _hot_links(spark, sets, left.where(F.col("c") > COLD), known, levels, percent)
    discard(left, known, levels)
    return first.unionByName(second).unionByName(third)


def _matching(pairs: DataFrame, known: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) with near sizes, those whose lengthened prefixes share as many tokens as the smaller of the two levels asks for."""
    pairs = materialise(pairs, "candidates")

    def side(x: str) -> DataFrame:
        own = _preselect(known, pairs.select(F.col(x).alias("rid"))).join(levels, "rid")
        return own.select(F.col("rid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "prefix", "level")])

    def run(batches):
        for batch in batches:
            keep = []
            for a_n, a_prefix, a_level, b_n, b_prefix, b_level in zip(*(c.to_pylist() for c in batch.columns[2:])):
                a_least, b_least = _least(a_n, percent), _least(b_n, percent)
                need = min(a_level, b_level, a_least, b_least)
                a, b = _numbered(a_prefix)[: a_n - a_least + need], _numbered(b_prefix)[: b_n - b_least + need]
                keep.append(len(np.intersect1d(a, b, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *[f"{x}_{c}" for x in "ab" for c in ("n", "prefix", "level")]).mapInArrow(run, "a long, b long")


def _hot_links(spark, sets: DataFrame, left: DataFrame, known: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """Links among members of different classes of long lists, found in blocks of bounded size.

    A first pass over prefixes tells which members have a matching partner at all; only these bring their whole sets to the second.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def in_blocks(members: DataFrame, docs: DataFrame, last: str, whole: bool) -> DataFrame:
        # The largest class of a list has the first chunks; they meet the chunks of the rest, not each other.
        size = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
        size = size.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"))
        size = size.where("top.m < m").select("token", F.col("top.label").alias("main"), *[F.ceil(x / CHUNK).cast("long").alias(y) for x, y in ((F.col("top.m"), "own"), (F.col("m") - F.col("top.m"), "rest"))])
        main, at = F.col("label") == F.col("main"), F.xxhash64("rid")
        dealt = members.drop("n").join(size, "token").withColumn("chunk", F.when(main, F.pmod(at, F.col("own"))).otherwise(F.col("own") + F.pmod(at, F.col("rest"))))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(main, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("rest") - 1)))
        low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
        rows = dealt.join(docs, "rid").select("token", low, high, "chunk", "rid", "label", "level", "prefix", last)
        rows = rows.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        return rows.mapInArrow(_blocks(percent, whole), "a long, b long")

    def short(members: DataFrame) -> DataFrame:
        return _preselect(known, members.select("rid")).join(levels, "rid").select("rid", "prefix", "level", "n")

    met = in_blocks(left, short(left), "n", False).distinct().select(F.col("a").alias("token"), F.col("b").alias("rid"))
    near = materialise(left.join(met, ["token", "rid"]), "near")
    docs = _fetch(sets, near.select("rid")).join(short(near), "rid")
    links = materialise(in_blocks(near, docs, "tokens", True), "links")
    discard(near)
    return links


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""
    pairs = materialise(pairs, "pairs")
    side = lambda x: _fetch(sets, pairs.select(F.col(x).alias("rid"))).select(F.col("rid").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialise(both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(_pair_filter(percent), "a long, b long"), "links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without near copies: of every link class only the row with the smallest key stays (NULL keys come last, then
    the text's digest decides). A row that is repeated with the same key and text stays once. Documents without words always stay.
    """
    found, written = _classes(docs, key, text, words, percent)
    classes = materialise(found.where("n > 0"), "members")
    discard(*written)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    best = classes.groupBy("label").agg(F.min(place).alias("best")).select("label", "best")
    kept = classes.join(best, "label").withColumn("stays", place == F.col("best"))
    verdict = kept.groupBy("doc_id", "same").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    verdict = materialise(verdict.where("not stays or times > 1"), "verdicts")
    discard(classes)
    at, digest = free_name(docs, "_key"), free_name(docs, "_same")
    own = docs.withColumns({at: F.col(key).cast("long"), digest: F.unhex(F.md5(F.encode(F.col(text).cast("string"), "UTF-8")))})
    met = own[at].eqNullSafe(verdict["doc_id"]) & (own[digest] == verdict["same"])
    rest = own.join(small(verdict), met, "left_anti")
    if not verdict.where("stays").isEmpty():
        again = own.join(small(verdict.where("stays")), met, "left_semi").dropDuplicates([at, digest])
        rest = rest.unionByName(again)
    return rest.drop(at, digest)
