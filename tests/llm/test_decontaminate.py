import random
import re

from truegauge.llm.decontaminate import find_items, without_items


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    out = set()
    for d, text, *_ in docs:
        for i, item in items:
            a, b = grams(text), grams(item)
            if b and 100 * len(a & b) >= 80 * len(b):
                out.add((d, i, len(b), len(a & b)))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 7, 9, 16, 40, 59])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "only three words"), (0, items[0][1]), (103, items[1][1].upper()), (None, " ".join(word() for _ in range(20)))]
    docs = []
    for i in range(300):
        w = [word() for _ in range(rng.choice([0, 3, 50, 400, 3000]))]
        if i % 3:
            part = (rng.choice(items)[1] or "").split()
            cut = rng.choice([0, 0, 1, len(part) // 5])
            at = rng.randint(0, len(w))
            w[at:at] = part[cut:]
        docs.append((i, " ".join(w), "x"))
    docs += [(None, items[3][1], "n"), (900, None, "n"), (901, "", "n"), (902, "Only Three\nwords", "n"), (5, items[4][1], "n"), (5, items[4][1], "n")]
    return docs, items


def test_matches_all_pairs(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = find_items(d, i).drop("containment", "same").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(docs, items)
    assert len(got) > 100
    left = without_items(d, i).collect()
    bad = {(r[0], t) for r in brute(docs, items) for k, t, _ in docs if k == r[0] and any(100 * len(grams(t) & grams(x)) >= 80 * len(grams(x)) for _, x in items if grams(x))}
    assert len(left) == sum((r[0], r[1]) not in bad for r in docs)
    assert not {(r.doc_id, r.text) for r in left} & bad


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_items(docs, none).collect() == [] and without_items(docs, none).count() == 1
    assert find_items(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
