"""Exact laws of rank statistics of small samples, for aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two samples of up to so many rows each get the exact law of their largest gap; it takes time with the product of the sizes.
KS_ROWS = 10_000
#: Two samples of up to so many rows together get the exact law of their rank sum, ties included.
RANK_ROWS = 60


def touch_probability(n: int, m: int, gap: int) -> float:
    """Probability that a random order of ``n`` and ``m`` distinct values has ``|i m - j n| >= gap`` somewhere, ``i`` and ``j`` being how many of each came so far.

    Lattice paths, one diagonal ``i + j`` at a time; a point's value is the share of the paths to it that touched the bound. Only positive
    terms are added, so small probabilities keep their digits.
    """
    n, m = min(n, m), max(n, m)
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    share = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        low, high = max(0, s - m), min(s, n)
        at = i[low : high + 1]
        now = share[low : high + 1] * ((s - at) / s)
        first = 1 if low == 0 else 0
        now[first:] += share[low + first - 1 : high] * (at[first:] / s)
        now[np.abs(at * m - (s - at) * n) >= gap] = 1.0
        share[low : high + 1] = now
    return float(share[n])


def rank_sum_p(ties, first) -> float:
    """Two-sided probability of the rank sum (twice the smaller tail, 1 at most) among all ways to choose the first sample.

    ``ties`` are the counts of the distinct values in ascending order, ``first`` how many of each are of the first sample. Equal values share their
    mean rank; ranks are doubled, so sums are whole.
    """
    ties, first = [int(x) for x in ties], [int(x) for x in first]
    chosen, rows = sum(first), sum(ties)
    if not 0 < chosen < rows:
        return math.nan
    most = 2 * rows * chosen
    ways = np.zeros((chosen + 1, most + 1))
    ways[0, 0] = 1.0
    before = observed = 0
    for t, f in zip(ties, first):
        rank = 2 * before + t + 1
        new = ways.copy()
        for c in range(1, min(t, chosen) + 1):
            new[c:, c * rank :] += math.comb(t, c) * ways[: chosen + 1 - c, : most + 1 - c * rank]
        ways, before, observed = new, before + t, observed + f * rank
    law = ways[chosen] / math.comb(rows, chosen)
    return min(1.0, 2 * min(law[: observed + 1].sum(), law[observed:].sum()))


@F.pandas_udf(T.DoubleType())
def ks_exact(n: pd.Series, m: pd.Series, ks: pd.Series) -> pd.Series:
    """Probability of a gap of ``ks`` or more; NULL where an input is, or a sample has no rows or more than ``KS_ROWS``."""
    known, out = {}, []
    for a, b, d in zip(n, m, ks):
        if pd.isna(a) or pd.isna(b) or pd.isna(d) or not (0 < a <= KS_ROWS and 0 < b <= KS_ROWS):
            out.append(np.nan)
            continue
        key = (int(a), int(b), round(d * int(a) * int(b)))
        if key not in known:
            known[key] = touch_probability(*key)
        out.append(known[key])
    return pd.Series(out, index=n.index, dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_exact(ties: pd.Series, first: pd.Series) -> pd.Series:
    """:func:`rank_sum_p` of arrays; NULL where they are empty or one sample is."""
    known, out = {}, []
    for t, f in zip(ties, first):
        key = (tuple(t), tuple(f)) if t is not None and f is not None else ((), ())
        if key not in known:
            known[key] = rank_sum_p(*key)
        out.append(known[key])
    return pd.Series(out, index=ties.index, dtype="float64")
