import random
import re

import numpy as np
import pytest

from truegauge.llm import ngram_join
from truegauge.llm.components import components


def brute(rows, k, percent):
    """Class id per row by comparing every two sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            ids[x] = min(ids.get(x, i), i)
    return sorted(((i, len(s), ids.get(x)) for (i, _), s, x in zip(rows, sets, label)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 60))
    passage = [word() for _ in range(25)]
    bases = [[word() for _ in range(rng.choice([4, 20, 60, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 40))] + passage
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w).swapcase() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,k,percent,chunk", [(1, 3, 90, 192), (2, 3, 90, 8), (3, 5, 80, 5)])
def test_matches_all_pairs(spark, monkeypatch, seed, k, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "COLD", 32 if chunk > 100 else chunk - 4)
    rows = corpus(seed, 220) + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "One"), (3, "again words"), (None, "one"), (None, "x y")]
    rows += [(905, rows[0][1]), (906, rows[0][1])]
    got = ngram_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=k, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, percent)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "other text of its own", "z"), (2, "other text of its own", "z"), (7, None, "n"), (8, None, "n"), (None, "A b c d e f g", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((tuple(r) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(2, "a b c d e f g", "y"), (2, "other text of its own", "z"), (7, None, "n"), (8, None, "n")], key=str)


def test_keep_one_with_clashing_names(spark):
    rows = [(2, "a b c d e f g", "k2", 1, "p"), (5, "a b c d e f g", "k5", 2, "q"), (3, "other text of its own", "k3", 3, "r"), (3, "other text of its own", "k3", 3, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _Key string, _same int, _key_ string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_classes(none).collect() == [] and ngram_join.keep_one(none).collect() == []


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 230), rng.randint(200, 260)) for _ in range(25)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


def test_scratch_tables_go_once_the_verdicts_are_written(spark):
    """Sets, prefixes and lists stayed on disk until the end: 2.6 times the input beside the later stages."""
    from pathlib import Path

    from truegauge.session import shared_dir

    root = Path(shared_dir(spark).removeprefix("file://")) / "truegauge" / spark.sparkContext.applicationId
    folders = lambda: {p.name for p in root.iterdir()} if root.exists() else set()
    before = folders()
    texts = [f"w{i % 7} a{i % 7} b c d e f g h i{i % 7} j" for i in range(30)] + ["", None]
    kept = ngram_join.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    big = {x.split("-")[0] for x in folders() - before}
    assert "verdicts" in big and not big & {"sets", "classes", "prefixes", "shared", "listed", "known", "levels", "marked", "open", "near", "members"}
    assert sorted(r.doc_id for r in kept.collect()) == [*range(7), 30, 31]


def test_only_nodes_moves_no_sets(spark):
    """Every prefix was shuffled to leave out the few sets that two tasks have: 202 MB for 0.51 GB."""
    sets = spark.createDataFrame([(i, 3, b"t%d" % i if i % 5 else None, b"w") for i in range(200)], "rid long, n long, tokens binary, weights binary")
    nodes = spark.createDataFrame([(i,) for i in range(200) if i % 5 and i % 7], "rid long")
    got = ngram_join._only_nodes(sets, nodes)
    assert sorted(r.rid for r in got.collect()) == [i for i in range(200) if i % 5 and i % 7]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_nodes_that_the_bitmap_names_by_mistake_stay(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SET_BITS", 6)
    test = [(i, 3, b"t%d" % i, b"w") for i in range(60)]
    sets = spark.createDataFrame(test, "rid long, n long, tokens binary, weights binary")
    nodes = spark.createDataFrame([(i,) for i in range(60) if i % 3], "rid long")
    assert sorted(r.rid for r in ngram_join._only_nodes(sets, nodes).collect()) == [i for i in range(60) if i % 3]


def test_fingers_never_hide_a_shared_token():
    """Tokens with equal high bytes are told apart by their number, so matches are counted in full."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = (rng.integers(0, 6, 40).astype(np.uint64) << np.uint64(32)) | (rng.integers(0, 1 << 16, 40).astype(np.uint64) << np.uint64(16))
        a, b = (np.unique(rng.choice(pool, 15)) for _ in range(2))
        x, y = (ngram_join._numbered(ngram_join._fingers(rng.permutation(t))) for t in (a, b))
        assert len(np.unique(x)) == len(a) and len(np.unique(y)) == len(b)
        assert len(np.intersect1d(x, y)) >= len(np.intersect1d(a, b))
    assert len(ngram_join._numbered(b"")) == 0


def test_counters_travel_narrow_and_whole():
    for places in ([0], [65535], [0, 1, 2, 300, 65535], range(0, 65536, 3)):
        where = np.array(places)
        for top in (1, 255, 256, 70_000):
            part = np.full(len(where), top, np.uint32)
            gaps, counts = (ngram_join._narrow(x).tobytes() for x in (np.diff(where, prepend=0), part))
            assert (np.cumsum(ngram_join._widen(gaps, len(where))) == where).all() and (ngram_join._widen(counts, len(where)) == part).all()
    assert len(ngram_join._narrow(np.array([1, 255])).tobytes()) == 2
