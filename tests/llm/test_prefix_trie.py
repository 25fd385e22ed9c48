import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm.prefix_trie import WIDTH, ZFastTrie, fattest, rebuilt, sequences, trie_nodes


def path_of(letters):
    out, at = [], b""
    for c in letters:
        at = hashlib.blake2b(at + c.encode(), digest_size=WIDTH).digest()
        out.append(at)
    return b"".join(out)


def test_two_fattest():
    for low in range(70):
        for high in range(low + 1, 70):
            want = max(range(low + 1, high + 1), key=lambda x: (x & -x, -x))
            assert fattest(low, high) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=20), min_size=1, max_size=25))
def test_trie_of_any_order(words):
    trie = ZFastTrie()
    half = len(words) // 2
    ends = trie.insert_batch([path_of(w) for w in words[:half]]) + trie.insert_batch([path_of(w) for w in words[half:]])
    for w, v in zip(words, ends):
        assert trie.depth[v] == len(w) and trie.path[v][: WIDTH * len(w)] == path_of(w)
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    branch = {p for p in prefixes if len({w[len(p)] for w in words if w.startswith(p) and len(w) > len(p)}) > 1}
    assert {trie.path[v][: WIDTH * trie.depth[v]] for v in range(len(trie.path))} == {path_of(p) for p in branch | set(words) | {""}}
    for v in range(1, len(trie.path)):
        top, end = trie.depth[trie.parent[v]], trie.depth[v]
        at = fattest(top, end)
        assert trie.handles[trie.path[v][WIDTH * (at - 1) : WIDTH * at]] == v and trie.path[trie.parent[v]][: WIDTH * top] == trie.path[v][: WIDTH * top]
    assert len(trie.handles) == len(trie.first) == len(trie.path) - 1
    for w in ["", "a", "abab", "bbbbb", *words, *[w + "a" for w in words]]:
        node, agree = trie.locate(path_of(w))
        assert agree == max(d for d in range(len(w) + 1) if w[:d] in prefixes)
        assert trie.depth[node] >= agree and (node == 0 or trie.depth[trie.parent[node]] < max(agree, 1))


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in turns.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()
    )


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, parent string")


@pytest.mark.parametrize("chunk, partitions", [(8192, 1), (3, 1), (1, 7), (4, 40)])
def test_nodes(spark, chunk, partitions):
    rng = random.Random(chunk)
    rows = []
    for c in range(150):
        same = rng.choice([None, 3, 40])
        r = random.Random(same) if same else rng
        for t in range(rng.choice([0, 1, 3, 7, 30])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["hi", "héllo", "", None, "😀 x", "system"])))
    rows += [(500 + i, t, "user", "copy") for i in range(60) for t in range(9)] + [(700 + i, t, "user", "copy") for i in range(30) for t in range(9 + i % 4)]
    rows += [(None, 0, "user", "no id"), (900, 1, "a", "tie"), (900, 1, "a", "tie"), (900, 1, "b", "tie"), (-7, 0, "user", "hi")]
    rows += [(1000, t, "user", f"{t}") for t in range(300)] + [(1001, t, "user", f"{t}") for t in range(150)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in trie_nodes(rebuilt(sequences(table_of(spark, rows))), chunk).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_and_turnless(spark):
    empty = table_of(spark, [(1, 0, "u", "x")]).where("false")
    assert trie_nodes(rebuilt(sequences(empty))).collect() == []
    alone = next(c for c in range(6, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(alone, 0, "user", "gone")]
    got = [tuple(r) for r in trie_nodes(rebuilt(sequences(table_of(spark, rows)))).collect()]
    assert got == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
