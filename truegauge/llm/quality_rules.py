"""Line-first cleaning with DataFrame functions alone: rules per line, removal of failing lines, then a verdict on the document.

A line fails by

* punctuation: at least ``SYMBOL_SHARE`` percent as many odd symbols, or as many doubled ``!`` and ``?``, as words; or more than ``LONG_LINE`` words without a single
  sentence mark;
* navigation: at least three separators (``|`` ``»`` ``«`` ``›`` ``•`` ``·`` or a lone ``>``), one to four words or fewer each;
* boilerplate: one of the ``BOILERPLATE`` phrases.

A document is kept if it passes the base limits and at least ``KEPT_SHARE`` percent of its characters outside white space stand in lines that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import bind, ready

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_SHARE = 30
SYMBOL_SHARE = 25
LONG_LINE = 40
KEPT_SHARE = 50
SENTENCE_MARK = r"[.!?:;…。！？।؟]"
DOUBLED = r"[!?]{2}"
SEPARATOR = r"[|»«›•·]|(?:^|[\x20\x09-\x0D])>(?:$|[\x20\x09-\x0D])"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie (policy|settings|consent)|(use|uses|accept|enable) (all )?cookies|privacy policy|terms (of|and) (use|service|conditions)"
    r"|enable javascript|javascript (is|must be) |lorem ipsum|sign up for our newsletter|subscribe to our|click here to|skip to (main )?content|back to top"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur at least twice in the text, the first one included.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts with a repeated window are sorted.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bind(
        hashes, lambda h: F.when(F.size(h) >= window, F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window))))
    )

    def covered(found: Column) -> Column:
        """Positions of repeated windows, ascending, to the number of words they cover."""
        gaps = F.transform(found, lambda p, j: F.coalesce(F.least(F.lit(window), p - F.get(found, j - 1)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(order: Column) -> Column:
        twice = lambda j, k: F.coalesce(F.get(order, j)["h"] == F.get(order, k)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda j: twice(j, j - 1) | twice(j, j + 1))
        return bind(F.sort_array(F.transform(at, lambda j: F.get(order, j)["i"])), covered)

    numbered = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), bind(numbered(w), repeated)).otherwise(F.lit(0).cast("long")))


def line_passes(line: Column) -> Column:
    """Whether a line with at least one word passes the three rules."""
    words = F.size(words_of(line))
    symbols, doubled, breaks = (F.regexp_count(line, F.lit(p)) for p in (SYMBOL, DOUBLED, SEPARATOR))
    punctuation = (100 * F.greatest(symbols, doubled) >= SYMBOL_SHARE * words) | ((words > LONG_LINE) & ~line.rlike(SENTENCE_MARK))
    navigation = (breaks >= 3) & (4 * breaks >= words)
    return ~(punctuation | navigation | line.rlike(BOILERPLATE))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, the method's ``n_lines, n_bad_lines, line_chars,
    clean_chars`` and ``clean_text`` (passing lines, joined by line feeds), and ``kept``.

    NULL and empty texts have zeros, an empty clean text, and fail. NULL keys and repeated rows pass through; other columns are left out. No
    shuffle and nothing but built-in functions: every row is judged alone, whatever its length or neighbours.
    """
    ready(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("_t")).select("doc_id", "_t", words_of(F.col("_t")).alias("_w"), _word_lines(F.col("_t")).alias("_l"))
    long = lambda c: c.cast("long")
    sizes = F.transform(F.col("_l"), lambda x: F.struct(x.alias("line"), (F.length(x) - F.regexp_count(x, F.lit(SPACE))).alias("n"), line_passes(x).alias("ok")))
    base = rows.select(
        "doc_id",
        long(F.size("_w")).alias("n_words"),
        long(F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit(SYMBOL))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        sizes.alias("_s"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    good = F.filter("_s", lambda s: s["ok"])
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    out = base.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        long(F.size("_s")).alias("n_lines"), long(F.size("_s") - F.size(good)).alias("n_bad_lines"), chars(F.col("_s")).alias("line_chars"),
        chars(good).alias("clean_chars"), F.array_join(F.transform(good, lambda s: s["line"]), "\n").alias("clean_text"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("clean_chars") >= KEPT_SHARE * F.col("line_chars")))


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
