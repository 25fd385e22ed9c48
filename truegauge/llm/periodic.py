"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a longest stretch of consecutive words with smallest period ``q`` whose length is at least ``least`` and at least
``times * q``. Every word inside such a run stands in it ``times`` times or more. So a word that occurs more rarely in its segment is in no run:
it splits the segment, the parts are counted anew, and so on until nothing changes. What survives is scanned for lags by doubling windows: inside a
run of period ``q``, a window of ``B >= q`` words next comes back exactly ``q`` words later (a primitive word never matches a proper
rotation of itself). A stretch of windows with the same distance ``q``, ``B / 2 < q <= B``, therefore *is* a run, with its exact borders. The work is
n log n in the words, whatever their periods.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import WordHasher, free_name, mix, ready, text_slices

LEAST, TIMES = 24, 3
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Words recounted while splitting, as a multiple of all words. Beyond it, what is left goes to the scan, which finds the same runs in it.
RECOUNTS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def surviving(codes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the segments left by splitting at words that occur less than ``times`` times in their segment, again and again.

    ``codes`` are dense numbers of the words of several texts, ``first`` each text's first word (one more entry than texts).
    """
    start, length = first[:-1].astype(np.int64), np.diff(first).astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    budget = RECOUNTS * max(1, len(codes))
    while True:
        long = length >= max(least, times)
        start, length = start[long], length[long]
        if not len(start) or budget < 0:
            break
        end = np.cumsum(length)
        budget -= int(end[-1])
        segment = np.repeat(np.arange(len(start)), length)
        place = np.arange(end[-1]) + np.repeat(start - end + length, length)
        inside, _ = pd.factorize(segment * (int(codes.max()) + 1) + codes[place])
        often = np.bincount(inside)[inside] >= times
        whole = np.ones(len(start), dtype=bool)
        whole[segment[~often]] = False
        done.append((start[whole], length[whole]))
        keep = often & ~whole[segment]
        place, segment = place[keep], segment[keep]
        begin = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0))
        start, length = place[begin], np.diff(np.append(begin, len(place)))
    done.append((start, length))
    start, length = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(start, kind="stable")
    return start[order], length[order]


def lag_scan(codes: np.ndarray, start: np.ndarray, length: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs inside the given segments, by start and then period."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    width = 1
    while 2 * width * times <= least:
        width *= 2
    low = 0
    while True:
        fit = length >= max(least, times * (low + 1), low + 1 + width)
        start, length = start[fit], length[fit]
        if not len(start):
            break
        # The segments one behind another, a mark of its own behind each.
        end = np.cumsum(length + 1)
        place = np.arange(end[-1]) + np.repeat(start - end + length + 1, length + 1)
        mark = end - 1
        grams = np.empty(end[-1], dtype=np.uint64)
        grams[:] = codes[np.minimum(place, len(codes) - 1)].astype(np.uint64)
        grams[mark] = np.arange(len(mark), dtype=np.uint64) + np.uint64(1 << 62)
        grams = mix(grams + _STEP)
        size = 1
        while size < width:
            grams = mix(grams[:-size] * _STEP + mix(grams[size:] + np.uint64(size)))
            size *= 2
        order = np.argsort(grams, kind="stable")
        lag = np.zeros(len(grams), dtype=np.int64)
        same = grams[order[:-1]] == grams[order[1:]]
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        at = np.flatnonzero((lag > low) & (lag <= width))
        if len(at):
            begin = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(lag[at], prepend=-1) != 0))
            last = np.append(begin[1:], len(at)) - 1
            period = lag[at[begin]]
            size = at[last] - at[begin] + width + period
            good = size >= np.maximum(least, times * period)
            found.append(np.stack([place[at[begin]], size, period], axis=1)[good])
        low, width = width, 2 * width
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in several texts, given the hashes of all their words; starts count through all texts."""
    if times < 3:
        raise ValueError("windows of a power of two find periods that come three times or more")
    codes, _ = pd.factorize(words.view(np.int64))
    return lag_scan(codes, *surviving(codes, first, least, times), least, times)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs``: its key, ``n_words``, ``runs`` (start word, length, period, by start and period) and ``collapsed``, the words outside
    the repetitions, joined by one space.

    Words are runs of bytes other than space and \\t to \\r, compared by 64-bit hashes. NULL and empty texts have no words, no runs and an empty
    ``collapsed``. Keys are passed through: NULL and repeated ones give a row each. Other columns are not read. Texts are worked on whole, some
    half a megabyte of them at a time (a longer one alone), without any shuffle. ``times`` is at least 3.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias(free_name(docs.select(key), "text")))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        hasher = WordHasher(fold=False)
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                words, first = hasher(raw, offsets)
                runs = runs_of(words, first, least, times)
                data, bounds = raw.tobytes(), np.searchsorted(runs[:, 0], first)
                n = len(first) - 1
                listed, left = [[]] * n, [b""] * n
                for i in range(n):
                    own = data[offsets[i] : offsets[i + 1]].split()
                    mine = runs[bounds[i] : bounds[i + 1]]
                    if len(mine):
                        mine = mine - np.array([first[i], 0, 0])
                        own = [own[j] for j in np.flatnonzero(kept_words(len(own), mine))]
                        listed[i] = [dict(zip(("start", "length", "period"), x)) for x in mine.tolist()]
                    left[i] = b" ".join(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n), pa.array(np.diff(first), pa.int64()),
                        pa.array(listed, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=[batch.schema.names[0], "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs {RUN}, collapsed string")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text of every row, the text of one row in ten (by its key's checksum) made to repeat from some word on.

    With ``h`` the unsigned crc32 of the key as text, ``g = floor(h / 10)`` and ``n`` words: if ``h`` divides by 10, word ``i >= a`` becomes word
    ``a + (i - a) % p``, ``a = g % n``, ``p = 1 + floor((n - a) / (3 + g % 8))``. Rows without key or words stay.
    """
    word = r"[^\x20\x09-\x0D]+"
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    chosen = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(word), F.lit(0))))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    chosen = chosen.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.concat_ws(
        " ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    )
    return chosen.select(F.col("key").alias(key), F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the run of the greatest exponent (ties: smallest start, then period) and checksums of :func:`find_runs`'s rows."""

    def better(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(y["start"].isNull() | (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))), x).otherwise(y)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda y, x: better(x, y))
    line = F.concat_ws("", F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))))
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
