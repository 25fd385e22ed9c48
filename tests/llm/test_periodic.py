import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from truegauge.llm.periodic import digests, find_runs, kept_words, planted, runs_of


def brute(words, least=24, times=3):
    """Every maximal stretch with its smallest period, by comparing all words at all lags."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and not any(s <= i and i + (j - i) + q <= e and q % p == 0 for s, e, p in seen):
                out.append((i, j - i + q, q))
                seen.add((i, j + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def hashes(words):
    return np.array([zlib.crc32(w.encode()) + (len(w) << 40) for w in words], dtype=np.uint64)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_all_lags(data):
    texts = []
    for _ in range(data.draw(st.integers(1, 4))):
        words = []
        for _ in range(data.draw(st.integers(0, 6))):
            unit = data.draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=12))
            words += unit * data.draw(st.integers(1, 12)) + unit[: data.draw(st.integers(0, len(unit)))]
        texts.append(words)
    least, times = data.draw(st.sampled_from([(24, 3), (6, 3), (5, 4), (1, 3)]))
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    got = runs_of(hashes([w for t in texts for w in t]), first, least, times)
    want = [(first[k] + s, m, q) for k, t in enumerate(texts) for s, m, q in brute(t, least, times)]
    assert [tuple(x) for x in got.tolist()] == [tuple(int(v) for v in x) for x in want]


def test_long_periods_and_lengths():
    rng = random.Random(3)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(70_000)]
    words = unit[:100] + unit * 3 + unit[:17] + ["end"] + ["x"] * 50_000
    got = runs_of(hashes(words), np.array([0, len(words)]))
    whole = [r for r in got.tolist() if r[2] == 70_000]
    assert whole == [[100, 210_017, 70_000]] and [210_118, 50_000, 1] in got.tolist()


def test_kept_words_of_overlapping_runs():
    runs = np.array([[2, 6, 2], [5, 9, 3]])
    drop = set(range(4, 8)) | set(range(8, 14))
    assert kept_words(16, runs).tolist() == [i not in drop for i in range(16)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(), n,
    )


def test_table(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "é", "😀", "b\x1c", "\xa0"])
    texts = [None, "", " \n\t ", "one", "la " * 23, "la " * 24, "la\nla " * 200, "a b " * 12 + "c " + "a b " * 15]
    for i in range(80):
        unit = [word() for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice([" ", "\n", "  \x0b"]).join([word() for _ in range(rng.randint(0, 40))] + unit * rng.randint(1, 9) + [word()]))
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts)] + [(5, "twice " * 40, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = digests(find_runs(planted(df))).collect()
    want = [expected(i, t) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert digests(find_runs(planted(df.where("false")))).collect() == []


def test_text_columns_and_key_names(spark):
    df = spark.createDataFrame([("k", "a b " * 20)], "text string, n_words string")
    got = find_runs(df, "text", "n_words", least=10, times=4).first()
    assert got["collapsed"] == "a b" and [tuple(r) for r in got["runs"]] == [(0, 40, 2)]
