"""Personal data with DataFrame functions alone: patterns propose spans, checksums confirm them, nearby words adjust the score.

Positions come from the text between matches: Java's split and extract-all walk over the same leftmost, non-overlapping matches, so a match starts where the
lengths of the pieces before it end. All positions count code points, ends are exclusive.

Patterns are written so that no text, however long, is scanned more than once from each run of characters: quantifiers are possessive where what follows can't be
part of the run, and a look-behind keeps a match from starting inside a run that has failed already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import bind, ready

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: A proposed span of the method's own kinds counts from this score on; spans of the base kinds always do.
ACCEPTED = 0.5
#: Characters before and after a span in which context words are looked for.
BEFORE, AFTER = 40, 20


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # cheap test of the text
    score: float  # of a span that the check confirms
    context: str  # words nearby that add CONTEXT
    base: bool = False


CONTEXT = 0.35
RUN = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{RUN}])|\G)[{RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6, "e-?mail|contact|write to|reach", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.5, r"\bip\b|host|server|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]{2}", 0.6, "card|visa|master|amex|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.5, r"phone|mobile|\bcell|\btel\b|call|fax|whatsapp", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.6, "iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.3, r"social security|\bssn\b|taxpayer"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "[0-9]{4}", 0.3, r"phone|mobile|\bcell|\btel\b|call|fax|whatsapp"),
    Kind("secret", r"(?i)(?<![A-Za-z0-9_])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd)\x22?\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_.-]{12,}+[\x22']?", "[=:]", 0.5, "secret|private|credential"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn sum is a multiple of ten."""

    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Rest of an account number by 97: first four characters last, letters as 10 to 35."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))

    def add(rest, i):
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return value.rlike("[=:].*[0-9]") & value.rlike("[=:].*[A-Za-z]")
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(a, both):
            at = a["at"] + both["g"]
            return F.struct((at + F.length(both["h"])).alias("at"), F.array_append(a["starts"], at).alias("starts"))

        starts = F.aggregate(F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g")), start, step, lambda a: a["starts"])
        rows = F.transform(F.arrays_zip(hits.alias("h"), starts.alias("s")), lambda z: F.struct(z["h"].alias("value"), z["s"].alias("start")))
        near = lambda z: F.lower(
            F.concat_ws(
                " ", F.substring(text, F.greatest(z["start"] + 1 - BEFORE, F.lit(1)), F.least(z["start"], F.lit(BEFORE))),
                F.substring(text, z["start"] + F.length(z["value"]) + 1, F.lit(AFTER)),
            )
        )
        score = lambda z: kind.score + F.when(near(z).rlike(kind.context), CONTEXT).otherwise(0.0)
        good = F.filter(rows, lambda z: confirmed(kind.name, z["value"]))
        made = F.transform(
            good, lambda z: F.struct(F.lit(kind.name).alias("kind"), z["start"].alias("start"), (z["start"] + F.length(z["value"])).alias("end"), score(z).alias("score"))
        )
        return made.cast(SPAN)

    hits = F.when(text.rlike(kind.needs), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    return bind(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(F.array().cast(SPAN)))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, an array column for each base kind, and ``more``: accepted spans of the other kinds that overlap no base span.

    NULL and empty texts have empty arrays. NULL keys and repeated rows pass through, other columns are left out. Rows are handled alone, no shuffle.
    """
    return _found(docs, key, text)


def _found(docs: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """Rows of ``find``; with ``whole``, ``more`` also has the secrets that hold or touch a base span, such as a card number inside a token."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    base = [k for k in KINDS if k.base]
    rows = rows.select("doc_id", "_t", *[spans_of(F.col("_t"), k).alias(k.name) for k in base])
    clear = lambda s: ~F.exists(F.concat(*[F.col(k.name) for k in base]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def accepted(k: Kind) -> Column:
        free = whole and k.name == "secret"
        return F.filter(spans_of(F.col("_t"), k), lambda s: (s["score"] >= ACCEPTED) & (F.lit(True) if free else clear(s)))

    more = [accepted(k) for k in KINDS if not k.base]
    return rows.select("doc_id", "_t", *[k.name for k in base], F.concat(*more).alias("more"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans as ``kind:start:end`` text."""
    found = find(docs, key, text)
    base = F.concat(*[F.col(k.name) for k in KINDS if k.base])
    return found.select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.concat(base, "more")).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; overlapping spans become one, and a secret goes whole even around a base span. ``length``, if there is such a column, is set anew."""
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).cast("string").alias("_text"))
    found = _found(out.withColumn("_key", F.col("_row")), "_key", "_text", whole=True)
    spans = F.array_sort(F.transform(F.concat(*[F.col(k.name) for k in KINDS if k.base], F.col("more")), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(a, s):
        new = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substring(F.col("_t"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("_t"), a["at"] + 1, F.length("_t"))))
    row = F.col("doc_id")
    made = found.select(row.alias("_row"), F.when(row[text].isNotNull(), clean).alias("_clean"))
    columns = []
    for c in docs.columns:
        col = F.col("_row")[c]
        if c == text:
            col = F.col("_clean")
        elif c == length:
            col = F.when(F.col("_clean").isNotNull(), F.length("_clean")).cast(docs.schema[c].dataType)
        columns.append(col.alias(c))
    return made.select(*columns)
