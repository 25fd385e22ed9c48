import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm import pieces
from truegauge.llm.pieces import SPACE, UNIGRAM, Encoder, Pieces, digest, encode, merge_by_rank

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "\t\nq\x00", "日本語テキスト😀ﬁ", "a" * 300, " " * 70 + "b", "<s></s><unk>", "ééé ´", "x" * 3 + " " * 17, "long " * 3000, "ab" * 4000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return Encoder(Pieces.load(PATH))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_library(library, coder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, first = coder.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode(t) for t in texts]
    assert coder.decode(ids, first) == [t.replace(SPACE, " ") for t in texts]


def test_unbroken_text(library, coder):
    """Words that take long: no blanks at all, with and without places to cut, and a run of one character."""
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = [pick("ABCabcXYZxyz0189+/", 60_000), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(20_000)), "a" * 20_000, pick("etaoinshr", 6000), "-=" * 5000, pick("abé😀", 3000), "▁" * 300]
    for w in [*words, "x " + words[3][:500] + " y " + words[3][:500]]:
        ids, _ = coder.encode([w.encode()])
        assert ids.tolist() == library.encode(w)


def test_pairs_survive_a_small_store(library, monkeypatch):
    monkeypatch.setattr(pieces, "PAIR_BITS", 3)
    small = Encoder(Pieces.load(PATH))
    text = "many different words, and their neighbours (in a tiny store) still come out right: naïve façade 12345 " * 3
    assert small.encode([text.encode()])[0].tolist() == library.encode(text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1 - i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (-1, "", "x")], "doc_id long, text string, ids string")
    got = encode(docs.unionByName(extra, allowMissingColumns=True), PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1 - i: t for i, t in enumerate(ODD)} | {None: ""}
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.round_trip and r.decoded == texts[r.doc_id]
    assert encode(docs.where("false"), PATH).collect() == []
    d = digest(encode(docs, PATH)).collect()
    assert {(r.doc_id, r.n_ids, r.n_decoded) for r in d} == {(k, len(library.encode(t)), len(t)) for k, t in texts.items() if k is not None and k >= 0}


def test_unigram_search_is_optimal():
    rng = random.Random(1)
    pieces = ["<unk>"] + ["".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n) if n == 1 or rng.random() < 0.4] + [SPACE]
    scores = [0.0] + [-rng.random() * 4 - len(p) * 0.2 for p in pieces[1:]]
    p = Pieces(pieces, scores, UNIGRAM, usable=[False] + [True] * (len(pieces) - 1))
    worth = dict(zip(pieces, scores))

    def best(text):
        top = {0: 0.0}
        for end in range(1, len(text) + 1):
            top[end] = max(top[s] + worth.get(text[s:end], p.worst if end - s == 1 else -1e9) for s in range(max(0, end - 3), end))
        return top[len(text)]

    words = [SPACE + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    ids, first = Encoder(p).encode([w[1:].encode() for w in words])
    for w, a, b in zip(words, first, first[1:]):
        own = ids[a:b].tolist()
        assert sum(p.worst if i == 0 else scores[i] for i in own) == pytest.approx(best(w))
        if 0 not in own:
            assert "".join(pieces[i] for i in own) == w


def test_pair_validity_equals_merging(coder):
    rng, p = random.Random(3), coder.p
    pool = [int(i) for i in p.ids if len(p.pieces[i]) < 6]
    for a, b in [(rng.choice(pool), rng.choice(pool)) for _ in range(400)]:
        text = p.pieces[a] + p.pieces[b]
        ids, lengths, _ = merge_by_rank(p, np.array([list(map(ord, text))], dtype=np.uint64))
        want = [int(i) for i, k in zip(ids[0], lengths[0]) if k] == [a, b]
        assert p.neighbours(np.array([a]), np.array([b]))[0] == want
