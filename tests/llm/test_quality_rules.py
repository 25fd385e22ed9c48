import random
import re

from truegauge.llm.quality_rules import judged

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(W, text)
    seen, twice = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(W, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w)


def test_base_columns(spark):
    rng = random.Random(4)
    some = lambda n, v: [rng.choice("abcdefgh") * rng.randint(1, v) for _ in range(n)]
    texts = [None, "", " \n\t", "one", "a\n\na\n a\na", "x " * 7, "x " * 8, "x " * 9, "x " * 30, "é😀 | # ñ" * 10, "a\x1cb \x85 c\xa0d " * 6]
    for _ in range(80):
        part = some(rng.randint(6, 12), 3)
        w = some(rng.randint(0, 60), 4) + part + some(rng.randint(0, 9), 4) + part * rng.randint(0, 2) + some(rng.randint(0, 60), 1)
        texts.append("".join(x + rng.choice([" ", " ", "\n", "\t ", " | "]) for x in w))
    texts.append(" ".join(some(20_000, 5)))
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, "one", "c"), (None, "one", "c")], "doc_id long, text string, kept string")
    got = {}
    for r in judged(docs).collect():
        got[r.doc_id] = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.base_failed and r.kept)
    assert got == {i: brute(t) for i, t in enumerate(texts)} | {None: brute("one")}


def test_verdicts(spark):
    prose = "The river rose in the night, and by the morning the fields were under water. Nobody slept, and the bells rang. It was over by noon."
    junk = {
        "symbols": " ".join(w + s for w, s in zip(prose.split(), ["###", "&&&", "$$$", "%%%"] * 9)),
        "shout": " ".join(w.upper() + "!!" for w in prose.split()),
        "menu": " | ".join(prose.replace(".", "").split()),
        "no marks": " ".join(f"w{i}" for i in range(60)),
        "boilerplate": "\n".join(["We use cookies on this site to give you the best of it.", "Read our privacy policy for the whole story about data."] * 1 + ["Please enable JavaScript to go on with this page."]),
    }
    good = {"prose": prose, "mixed": prose + "\nHome | News | About | More", "title": "A title\n" + prose}
    rows = [(k, v) for k, v in (junk | good).items()]
    out = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k for k, r in out.items() if r.kept} == set(good)
    assert out["mixed"].clean_text == prose and out["mixed"].n_bad_lines == 1 and out["title"].clean_text == good["title"]


def test_empty(spark):
    assert judged(spark.createDataFrame([], "doc_id long, text string")).collect() == []
