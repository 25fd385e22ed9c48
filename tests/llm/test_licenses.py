import random
import re
import time

import pytest

from truegauge.llm import licenses
from truegauge.llm.licenses import evaluate, postfix, scan, tag_tokens

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, v) for k, v in PHRASES.items() for i in range(len(w)) if w[i : i + k.count(" ") + 1] == k.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))


def test_base_columns(spark):
    rng = random.Random(2)
    bits = ["MIT", "License", "mit license", "the", "Apache", "license", "General Public", "public License", "é", "x\x00y", "_", "mit-LICENSE", "mitlicense", "日本", "2.0", "İ"]
    texts = [None, "", "..."] + ["".join(rng.choice(bits) + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    texts.append("mit license " * 4000)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(2, "...", "z"), (None, None, "z")], "doc_id long, text string, labels string").repartition(5)
    got = scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute(None if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_method_labels(spark):
    texts = {
        "tag": "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\ncode", "bad tag": "SPDX-License-Identifier: OR MIT",
        "notice": "Licensed under the Apache License, Version 2.0 or the MIT License, at your option.", "lgpl": "the GNU Lesser General Public License",
        "cc": "Licensed under CC BY-NC 4.0.", "rights": "All rights reserved", "none": "a plain text",
    }
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got["tag"].labels == "bsd,gpl,mit" and got["tag"].permissive and got["tag"].score == 1.0
    assert got["bad tag"].labels == "" and got["bad tag"].score == 0.0
    assert got["notice"].labels == "apache,mit" and got["notice"].permissive and got["notice"].expression == "apache mit or" and got["notice"].score == 0.9
    assert got["lgpl"].labels == "gpl,lgpl" and got["lgpl"].base_labels == "gpl" and got["lgpl"].permissive is False
    assert got["cc"].labels == "cc-by-nc" and got["cc"].permissive is False and got["rights"].score == 0.3 and got["none"].score == 0


@pytest.mark.parametrize("text,want", [
    ("MIT", "MIT"), ("A or B and C", "A B C and or"), ("(A or B) and C", "A B or C and"), ("A with x and B", "A x with B and"), ("A and", None), ("(A", None),
    ("A)", None), ("or A", None), ("A or or B", None), ("A (B)", None), ("", None), ("((A))", "A"),
])
def test_postfix(text, want):
    assert postfix(re.findall(r"\w+|[()]", text)) == (want and want.split())


def test_evaluation():
    ok = lambda s: evaluate(postfix(tag_tokens(s)))[0]
    assert ok("MIT OR GPL-3.0") and not ok("MIT AND GPL-3.0") and not ok("GPL-2.0 WITH Classpath-exception-2.0") and ok("(GPL-2.0 OR MIT) AND Apache-2.0")
    assert tag_tokens("MIT this file is free") == ["MIT"]


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_outermost_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        names = sorted((rng.randrange(12), rng.randint(1, 5), "name", str(i)) for i in range(rng.randint(0, 14)))
        want = [p for p in names if not any(q is not p and q[0] <= p[0] and q[0] + q[1] >= p[0] + p[1] and q[1] > p[1] for q in names)]
        assert licenses.outermost(names) == want


def test_very_many_names_in_one_text():
    text = "released under the mit license or the apache license, gnu general public license version 2. " * 25_000
    words = f" {b' '.join(text.encode().translate(licenses._FOLD).split()).decode()} "
    start = time.process_time()
    got = licenses.scan_words(list(licenses.automaton().iter(words)), words, text)
    assert got["n_base"] == 75_000 and got["first_word"] == 3 and time.process_time() - start < 8
