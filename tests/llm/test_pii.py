import hashlib
import random
import re

from truegauge.llm.pii import redact, report

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return out


PIECES = [
    "ann.b%c+d@mail.example.co", "a@b", "a@b.c%x@d.e", "@", ".", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.1.9", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "79927398713", "+1 (017) 555-7713", "+1", "++12 34.56-7890", "+49 4111 1111 1111 1111", "é", "😀", "word", " ", "\n", ", ", "7", "12 34", "-", "ñ.3@x-y.z",
]


def test_base_spans(spark):
    rng = random.Random(8)
    texts = [None, "", "plain", *PIECES] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts += ["a" * 60_000, "a." * 30_000 + "@b.c", "1" * 60_000, "1 " * 30_000, "+" * 20_000 + "1 " * 20_000, "1.1.1.1," * 1500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "a@b.c", "x"), (None, "a@b.c", "x")], "doc_id long, text string, email string").repartition(8)
    seen = 0
    for r in report(docs).collect():
        want = brute("a@b.c" if r.doc_id is None or r.n_email and r.doc_id == 1 else texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in BASE]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and r.spans.startswith(written)
        seen += 1
    assert seen == len(texts) + 2


def test_own_kinds_and_context(spark):
    texts = {
        "iban": "Pay to DE89 3704 0044 0532 0130 00 by Friday", "bad iban": "Pay to DE88 3704 0044 0532 0130 00 by Friday", "ssn": "his social security number 219-09-9999 leaked",
        "no ssn": "part number 219-09-9999 in stock", "tel": "call 555-867-5309 now or call (555) 867-5309", "secret": 'set api_key = "a81f3c9d77e2b4501a" here',
    }
    got = {r.doc_id: r.spans for r in report(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    own = {k: [s.split(":")[0] for s in v.split(",") if s] for k, v in got.items()}
    assert own["iban"] == ["iban"] and own["bad iban"] == [] and own["ssn"] == ["ssn"] and own["no ssn"] == [] and own["tel"] == ["local_phone"] * 2 and own["secret"] == ["secret"]


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é mail a@b.c or +1 (017) 555-7713!", "m", 99), (2, None, "m", 3), (3, "nothing", None, None), (4, "ip 1.2.3.4", "m", 1)],
        "doc_id long, text string, more string, n_chars long",
    )
    got = [tuple(r) for r in redact(docs).orderBy("doc_id").collect()]
    assert got == [(1, "é mail [EMAIL] or [PHONE]!", "m", 26), (2, None, "m", None), (3, "nothing", None, 7), (4, "ip [IP]", "m", 7)]


def test_long_secrets(spark):
    """A token goes whole, however long, also around what looks like a card number."""
    token = lambda n: ("eyJ0eXAi.Qx7_-/+" * (n // 16 + 1))[:n]
    values = [token(12), token(200), token(201), token(500), token(5000), token(300) + "x4111111111111111y" + token(300)]
    texts = [f"set token={v} now" for v in values] + ["token: " + token(500) + "' and secret=\"" + token(5000) + '"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in report(docs).collect()}
    assert [spans[i] for i in range(5)] == [f"secret:4:{10 + len(v)}" for v in values[:5]]
    assert spans[6] == f"secret:0:508,secret:513:{513 + 8 + 5000 + 1}"
    assert spans[5].startswith("card:")
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert [clean[i] for i in range(6)] == ["set [SECRET] now"] * 6 and clean[6] == "[SECRET] and [SECRET]"


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert report(none).collect() == [] and redact(none).collect() == []
