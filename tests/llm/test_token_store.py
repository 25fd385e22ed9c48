import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from truegauge.llm.common import WordStore
from truegauge.llm.token_store import HashIndex, WordEncoder, keys_of, plain_rules, read_store, write_store

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Don't stop, 12 times! éÅ ÅNGSTRÖM", None, "", " \t\n", "a\x01b \x01 c", "<|endoftext|> and <|startoftext|>x", "a b c d", "é ́x",
    "\x1c\x1d z\x85y", "ΣΑΣ ΣΑΣ.", "long" * 5000, "x " * 3000, "日本語 テキスト 😀😀", "a\x00b",
]


def expected(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_store_round_trip(spark):
    rows = [(10 * i - 30, t, i) for i, t in enumerate(TEXTS)] + [(0, "same key", 7), (0, "same key", 8), (0, "another", 9), (None, "no key", 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int").repartition(3)
    store = write_store(docs, PATH)
    got = read_store(store, keys_of(docs)).collect()
    want = sorted(((i, expected(t)) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    have = sorted(((r.doc_id, list(r.ids)) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert have == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    unknown = spark.createDataFrame([(999, 0), (0, 5)], "doc_id long, copy long")
    assert read_store(store, unknown).collect() == []


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_store(write_store(docs, PATH), keys_of(docs)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).permutation(np.arange(n, dtype=np.uint64) * np.uint64(7919))
    index = HashIndex.from_bytes(HashIndex.build(keys, {"n": np.arange(n, dtype="<u4")}).to_bytes())
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(n)) and (index.columns["n"][slots] == np.arange(n)).all()
    if n:
        assert (index.slots(np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919 * 2) + np.uint64(1)) >= 0).sum() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, first = WordEncoder(PATH)(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [expected(t) for t in texts]


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    ids, first = encoder(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_words_that_differ_in_case_and_marks_are_encoded_once():
    """Each spelling used to go to the tokenizer of its own: 450 CPU seconds a GB."""
    encoder = WordEncoder(PATH)
    texts = ["Syllable syllable SYLLABLE syllable. syllable, Syllable!! (syllable)", "", "syllable,syllable été. Été! d'été?"]
    assert encoded(encoder, texts) == [expected(t) for t in texts]
    assert len(encoder.store) == 11  # syllable . , !! (syllable) ,syllable ét\u00e9 \u00c9t\u00e9 ! d'\u00e9t\u00e9 ?


@pytest.mark.parametrize(
    "text",
    ["<|endoftext|>. <|ENDOFTEXT|> <|EndOfText|>. x<|endoftext|>,Y", "<|startoftext|><|endoftext|>!A", "don't. DON'T! we'LL, 'S 's. x's.y 's,'t", "…. ×. ÷! ß. é. É, öÖ?ö e\u0301. E\u0301! .\u0301a",
     "a.b.C!!d 1.000,50% $5 #A&B* &&& %%%x İ. ſ. K. ΑΣ. ΑΣ,α", ". , !! .a a. Ã. Ã\u0097. ä.Ä", "A\x01. \x01 a\x01B!"],
)
def test_cuts_and_case_change_no_ids(text):
    encoder = WordEncoder(PATH)
    texts = [text, text.swapcase(), text[1:], "A. " + text + ".", text.replace(" ", "")]
    assert encoder.plain and encoded(encoder, texts) == [expected(t) for t in texts]


def test_other_rules_are_not_taken_for_plain_ones():
    from tokenizers import normalizers, pre_tokenizers

    t = Tokenizer.from_file(PATH)
    assert plain_rules(t)
    t.normalizer = normalizers.NFC()
    assert not plain_rules(t)
    t = Tokenizer.from_file(PATH)
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    assert not plain_rules(t)


def test_word_store_finds_what_it_holds():
    store, rng, asked = WordStore(5000), np.random.default_rng(3), []

    def encode(words):
        asked.extend(words)
        return np.array([int(w) for w in words], np.uint32), np.ones(len(words), np.int64)

    for _ in range(30):
        numbers = rng.integers(0, 3000, 400) * 2
        data, hashes = [str(x).encode() for x in numbers], numbers.astype(np.uint64) << np.uint64(40)  # all with equal low bits
        ends = np.cumsum([len(d) for d in data])
        rows = store.rows(hashes, np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends, encode)
        assert store.gather(rows, np.array([0, len(rows)]))[0].tolist() == numbers.tolist()
    assert len(asked) == len(set(asked)) == len(store) and (store.find(np.array([1, 1 << 39, 7001 << 40], np.uint64)) == -1).all()
    small = WordStore(300)
    assert len(small) == 0 and small.rows(hashes, np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends, encode).max() < 400
