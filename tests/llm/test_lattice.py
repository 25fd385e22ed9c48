import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm import lattice
from truegauge.llm.lattice import SPACE, Lattices, Vocabulary, score_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [SPACE, "a", "b", SPACE + "a", "ab", "ba", "aba", "bb", SPACE + "ab", "é"]
SCORES = [-2.0, -3.0, -3.1, -2.5, -2.8, -4.0, -5.0, -4.4, -3.3, -6.0]
SMALL = Vocabulary.of(PIECES, SCORES)


def ways(word):
    """All segmentations, as lists of symbols."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES:
            out += [[PIECES.index(word[:k]), *rest] for rest in ways(word[k:])]
        elif k == 1:
            out += [[*(len(PIECES) + b for b in word[0].encode()), *rest] for rest in ways(word[1:])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abéx😀", max_size=9), st.integers(1, 5)), min_size=1, max_size=8), st.booleans())
def test_sums_and_uses_equal_enumeration(items, long):
    words, counts = [w for w, _ in items], np.array([c for _, c in items])
    weights = SMALL.prior
    uses, want_uses, want = np.zeros(len(weights)), np.zeros(len(weights)), []
    for w, c in items:
        each = [(s, math.prod(weights[i] for i in s)) for s in ways(SPACE + w)]
        total = sum(p for _, p in each)
        want.append(math.log(total))
        for s, p in each:
            np.add.at(want_uses, s, c * p / total)
    old, lattice.LONG = lattice.LONG, 0 if long else lattice.LONG
    try:
        model = Lattices(SMALL, weights)
        got = model(words, counts, uses)
        assert np.allclose(model(words), got)
    finally:
        lattice.LONG = old
    np.testing.assert_allclose(got, want, rtol=1e-12)
    np.testing.assert_allclose(uses, want_uses, rtol=1e-9, atol=1e-12)


def test_long_word_and_both_walks_agree():
    vocabulary = Vocabulary.load(PATH)
    model = Lattices(vocabulary, vocabulary.prior)
    rng = random.Random(4)
    word = "".join(rng.choice(["the", "ing", "é", "x", "9", "日", "un"]) for _ in range(20))
    together = model([word] * 3)
    old, lattice.LONG = lattice.LONG, 0
    try:
        assert np.allclose(model([word]), together[0])
    finally:
        lattice.LONG = old
    assert math.isfinite(model([word * 2000])[0])


def test_rank_scores_are_no_probabilities():
    v = Vocabulary.of(["a", "b", "c"], [0.0, -1.0, -2.0])
    assert v.prior[0] / v.prior[1] == pytest.approx(11 / 10) and v.prior.sum() == pytest.approx(1)
    v = Vocabulary.of(["a", "b"], [math.log(0.6), math.log(0.3)])
    assert v.prior[0] / v.prior[1] == pytest.approx(2)


def expected(rows, rounds, vocabulary):
    """The contract's columns from plain counts and one lattice per distinct word."""
    fold = lambda t: [w.decode() for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    seen = Counter(w for i, t in rows if not held(i) for w in fold(t))
    ends = sum(not held(i) for i, _ in rows)
    total, kinds = sum(seen.values()) + ends, len(seen) + (ends > 0)
    weights = vocabulary.prior
    for _ in range(rounds if seen else 0):
        uses = vocabulary.prior * lattice.PRIOR * len(vocabulary.prior)
        Lattices(vocabulary, weights)(list(seen), np.array(list(seen.values())), uses)
        uses[-1] += ends
        weights = uses / uses.sum()
    model = Lattices(vocabulary, weights)
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    for i, t in rows:
        words = fold(t)
        yield (
            i, held(i), len(words) + 1, sum(seen[w] > 0 for w in words) + (ends > 0), total, sum(base(seen[w]) for w in words) + base(ends),
            (sum(model(words)) + model.end) / math.log(10),
        )


@pytest.mark.parametrize("share", [lattice.SHARE, 0.02, 2.0])
def test_table(spark, share):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "The", "of", "Été", "日本語", "x1", "😀", "a\x1cb", "tokens", f"w{rng.randrange(60)}"])
    rows = [(i, " \n".join(word() for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(60)]
    rows += [(70, None), (None, "the of"), (None, None), (3, "again the"), (3, "again the"), (71, "x" * 3000), (72, "\t ")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in score_texts(df, PATH, share=share).collect()), key=lambda r: str(r[:3]) + f"{r[5]:.6f}")
    want = sorted(expected(rows, lattice.ROUNDS, Vocabulary.load(PATH)), key=lambda r: str(r[:3]) + f"{r[5]:.6f}")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert score_texts(empty, PATH).collect() == []
    got = score_texts(spark.createDataFrame([(None, "some words")], "doc_id string, text string"), PATH).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.base_score == 0 and got.score < -3
