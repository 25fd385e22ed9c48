import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm import edit_counts
from truegauge.llm.edit_counts import CountTree, apply_edits, count_trees, encoding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENC = encoding(PATH, PATTERN)
COUNT = lambda x: len(ENC.encode_ordinary(x))
PIECE = st.text(alphabet="ab 's1\n\t.é\x1c\xa0 😀", max_size=30)


@settings(max_examples=150, deadline=None)
@given(PIECE, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), PIECE), max_size=8))
def test_counts_follow_edits(text, edits):
    old, edit_counts.LEAF = edit_counts.LEAF, 6
    try:
        tree = CountTree(text, COUNT)
        assert tree.total == COUNT(text)
        for a, b, new in edits:
            a = min(max(a, 0), len(text))
            b = min(max(b, a), len(text))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.total == COUNT(text) == tree.tokens[tree.size :].sum() and tree.chars[1] == len(text)
    finally:
        edit_counts.LEAF = old


def test_small_edit_of_long_text():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    tree = CountTree(text, COUNT)
    tree.encoded = 0
    tree.edit(50_000, 50_010, "some new words")
    assert tree.encoded < 5 * edit_counts.LEAF and tree.total == COUNT(text[:50_000] + "some new words" + text[50_010:])


def test_tables(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["one", "two's", "3", "\n", "é"]) for _ in range(rng.choice([0, 5, 800])))) for i in range(40)] + [(90, None), (91, None), (None, "no key"), (7, "again"), (None, None)]
    edits = [(rng.randint(0, 45), s, rng.randint(0, 900), rng.randint(0, 900), rng.choice(["", "x y", " ", "long " * 300])) for s in range(150)]
    edits += [(90, 1, 0, 0, "new"), (None, 1, 0, 0, "new"), (3, 999, None, None, "tail"), (4, 999, 0, 2, None)]
    state = count_trees(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, seq string"), PATH, PATTERN)
    got = apply_edits(state, spark.createDataFrame(edits, "doc_id int, seq int, start long, end long, replacement string"), PATH, PATTERN).collect()
    want = []
    for i, text in docs:
        mine = sorted((e for e in edits if e[0] == i and i is not None), key=lambda e: (e[1], e[2] or 0, e[3] or 0, e[4] or ""))
        new = text
        for _, _, a, b, r in mine:
            new, r = new or "", r or ""
            a = len(new) if a is None else min(a, len(new))
            b = len(new) if b is None else min(max(b, a), len(new))
            new = new[:a] + r + new[b:]
        want.append((i, new, COUNT(new or ""), COUNT(text or ""), len(mine)))
    assert sorted(((r.doc_id, r.text, r.n_tokens, r.n_before, r.n_edits) for r in got), key=str) == sorted(want, key=str)
    assert apply_edits(state.where("false"), spark.createDataFrame(edits, "doc_id int, seq int, start long, end long, replacement string"), PATH, PATTERN).collect() == []
