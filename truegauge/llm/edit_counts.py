"""Token counts that follow edits: a segment tree of pre-token runs per document, of which an edit re-encodes only the leaves it touches.

A leaf is a run of whole pre-tokens, about ``LEAF`` characters. Leaves are cut only where a character that is no white space is followed by a blank, a tab or a line feed: no
pre-token of the byte-level BPE pattern reaches over such a place, whatever stands around it, so counts of leaves add up to the count of the text. The tree holds sums of tokens in heap
order (node ``i`` has children ``2 i`` and ``2 i + 1``). After an edit the region is widened while its borders are no such places, cut into leaves again, and encoded; then
the sums above are updated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import free_name, ready

LEAF = 512
BLANKS = " \n\t"


def encoding(path: str, pattern: str):
    """Byte-level BPE of a file of ranks (base 64 of the bytes, a blank, the rank)."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_cut(before: str, after: str) -> bool:
    return after in BLANKS and not before.isspace()


def leaves_of(text: str) -> list[str]:
    """Leaves of a text: each has ``LEAF`` characters at least, but for the last, and ends at the first cut from there."""
    out, start, n = [], 0, len(text)
    while n - start > LEAF:
        at = start + LEAF
        while at < n and not is_cut(text[at - 1], text[at]):
            at += 1
        out.append(text[start:at])
        start = at
    if start < n:
        out.append(text[start:])
    return out


class CountTree:
    """Leaves of one document with sums of characters and tokens. ``encoded`` counts the characters that were encoded since it was made."""

    def __init__(self, text: str | None, count, lengths=None, tree=None):
        self.count, self.encoded = count, 0
        if tree is None:
            self.leaves = leaves_of(text or "")
            tokens = [self._tokens(x) for x in self.leaves]
        else:
            ends = np.cumsum(lengths).tolist()
            self.leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
            tokens = list(tree[len(tree) // 2 : len(tree) // 2 + len(ends)])
        self._build(tokens)

    def _tokens(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def _build(self, tokens: list[int]) -> None:
        size = 1
        while size < len(tokens):
            size *= 2
        self.size = size
        self.tokens, self.chars = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        self.tokens[size : size + len(tokens)] = tokens
        self.chars[size : size + len(tokens)] = [len(x) for x in self.leaves]
        for sums in (self.tokens, self.chars):
            low = size
            while low > 1:
                sums[low // 2 : low] = sums[low : 2 * low : 2] + sums[low + 1 : 2 * low : 2]
                low //= 2

    def _set(self, i: int, leaf: str, tokens: int) -> None:
        self.leaves[i] = leaf
        node = i + self.size
        self.tokens[node], self.chars[node] = tokens, len(leaf)
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character ``at`` (the last one for the end), and the place in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node]:
                if self.chars[node + 1] == 0:
                    continue
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put ``replacement`` in place of the characters from ``start`` to ``end``; both are brought into the text's range."""
        n = int(self.chars[1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if start == end and not replacement:
            return
        if not self.leaves:
            self.leaves = leaves_of(replacement)
            self._build([self._tokens(x) for x in self.leaves])
            return
        a, i = self.find(start)
        b, j = self.find(end)
        region = self.leaves[a][:i] + replacement + self.leaves[b][j:]
        while a > 0 and not (region and is_cut(self.leaves[a - 1][-1], region[0])):
            a -= 1
            region = self.leaves[a] + region
        while b + 1 < len(self.leaves) and not (region and is_cut(region[-1], self.leaves[b + 1][0])):
            b += 1
            region += self.leaves[b]
        new = leaves_of(region)
        tokens = [self._tokens(x) for x in new]
        if len(new) == b - a + 1:
            for k, (leaf, t) in enumerate(zip(new, tokens)):
                self._set(a + k, leaf, t)
        else:
            old = self.tokens[self.size : self.size + len(self.leaves)].tolist()
            self.leaves[a : b + 1] = new
            self._build([*old[:a], *tokens, *old[b + 1 :]])


def _state_row(tree: CountTree):
    return [len(x) for x in tree.leaves], tree.tokens.tolist()


def count_trees(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """State of every row: ``doc_id, text, leaf_chars, tree, n_tokens``. NULL texts stay NULL and have no tokens. NULL keys and repeated rows pass through."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoding(path, pattern)
        count = lambda x: len(enc.encode_ordinary(x))
        for batch in batches:
            trees = [CountTree(x, count) for x in batch.column(1).to_pylist()]
            state = [_state_row(t) for t in trees]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s[0] for s in state], pa.list_(pa.int32())), pa.array([s[1] for s in state], pa.list_(pa.int64())), pa.array([t.total for t in trees], pa.int64())],
                names=["doc_id", "text", "leaf_chars", "tree", "n_tokens"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, tree array<bigint>, n_tokens long")


RESULT = {
    "text": pa.string(), "leaf_chars": pa.list_(pa.int32()), "tree": pa.list_(pa.int64()), "n_tokens": pa.int64(), "n_before": pa.int64(), "n_edits": pa.int64(),
    "n_encoded": pa.int64(),
}


def apply_edits(state: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The state after ``edits`` (doc_id, seq, start, end, replacement), with ``n_before``, ``n_edits`` and ``n_encoded``, the characters that were encoded again.

    Edits of a document come in the order of ``seq`` (then start, end, replacement); each refers to the text that the ones before it left. Places count code
    points and are brought into the text's range; NULL places are its end, a NULL replacement is empty. Edits of unknown or NULL keys change nothing, a NULL text is edited as an
    empty one. Rows that share a key each get all of its edits and are held together; keys are meant to be unique. A document's edits pass by one at a time.
    """
    spark = ready(state.sparkSession)
    kind = state.schema["doc_id"].dataType.simpleString()
    seq = free_name(state, "seq")
    none = lambda t: F.lit(None).cast(t)
    left = state.select("doc_id", F.lit(0).alias("kind"), none("long").alias(seq), "text", "leaf_chars", "tree", none("long").alias("start"), none("long").alias("end"))
    right = edits.where("doc_id is not null").select(
        F.col("doc_id").cast(kind), F.lit(1).alias("kind"), F.col("seq").cast("long").alias(seq), F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("text"),
        none("array<int>").alias("leaf_chars"), none("array<bigint>").alias("tree"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(n, "doc_id").sortWithinPartitions("doc_id", "kind", seq, "start", "end", "text")

    def run(batches):
        enc = encoding(path, pattern)
        count = lambda x: len(enc.encode_ordinary(x))
        key, held, out = None, [], []

        def close():
            for tree, null, before, edited in held:
                chars, sums = _state_row(tree)
                text = None if null and not edited else tree.text
                out.append((key, text, chars, sums, tree.total, before, edited, tree.encoded))
            held.clear()

        def batch_of():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, t) for c, t in zip(columns[1:], RESULT.values())]], names=["doc_id", *RESULT])

        for batch in batches:
            key_type = batch.column(0).type
            for k, what, _, text, chars, sums, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if what == 0:
                    if k is None or k != key:
                        close()
                    key = k
                    tree = CountTree(text or "", count, chars, sums)
                    held.append((tree, text is None, tree.total, 0))
                elif k == key:
                    for i, (tree, null, before, edited) in enumerate(held):
                        size = int(tree.chars[1])
                        tree.edit(size if start is None else start, size if end is None else end, text)
                        held[i] = (tree, null, before, edited + 1)
            if len(out) >= 200:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    return both.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, tree array<bigint>, n_tokens long, n_before long, n_edits long, n_encoded long")
