"""Nearest-neighbour information against all pairs of rows."""

import math

import numpy as np
import pandas as pd
import pytest

from truegauge.operators.information import DIGAMMA, neighbour_information, search_strip


def psi(n):
    n = int(n)
    return -0.57721566490153286 + math.fsum(1 / j for j in range(1, n))


def brute(x, y, k):
    n = len(x)
    if n <= k:
        return None
    if x.std() < 1e-10 or y.std() < 1e-10:
        return 0.0
    dx, dy = abs(x[:, None] - x) / x.std(), abs(y[:, None] - y) / y.std()
    d = np.maximum(dx, dy)
    total = psi(n)
    for i in range(n):
        rho = np.sort(np.delete(d[i], i))[k - 1]
        near = k if rho > 0 else int((d[i] == 0).sum())
        total += (psi(near) - psi((dx[i] <= rho * (1 - 1e-9)).sum()) - psi((dy[i] <= rho * (1 - 1e-9)).sum())) / n
    return max(0.0, total)


def cases():
    rng = np.random.default_rng(4)
    n = 900
    z = rng.normal(size=n)
    heavy = np.where(rng.random(n) < 0.35, 1.5, rng.standard_cauchy(n))
    return pd.DataFrame({
        "z": z, "noisy": z + 0.3 * rng.normal(size=n), "curve": z**2 + 0.05 * rng.normal(size=n), "coarse": np.round(z, 1), "whole": rng.integers(0, 6, n).astype(float),
        "heavy": heavy, "copy": np.where(np.arange(n) < 400, 2.0, z), "flat": 3.25,
    })


PAIRS = [("z", "noisy"), ("z", "curve"), ("coarse", "whole"), ("heavy", "z"), ("copy", "whole"), ("flat", "z"), ("copy", "copy"), ("coarse", "heavy")]


@pytest.mark.parametrize("k, block", [(3, 16), (1, 512), (5, 40)])
def test_equals_all_pairs_of_rows(spark, k, block):
    pdf = cases()
    got = {(r.a, r.b): r.mi for r in neighbour_information(spark.createDataFrame(pdf), PAIRS, k, block).collect()}
    for a, b in PAIRS:
        assert got[a, b] == pytest.approx(brute(pdf[a].to_numpy(), pdf[b].to_numpy(), k), abs=1e-9), (a, b)


def test_strip_search_is_exact():
    rng = np.random.default_rng(1)
    for n, block, k in ((1, 4, 1), (3, 4, 3), (60, 5, 3), (200, 7, 6)):
        p = np.unique(np.round(rng.normal(size=(n, 2)), 1), axis=0)
        p = p[np.argsort(p[:, 1], kind="stable")]
        u, v, w = p[:, 0], p[:, 1], rng.integers(1, 4, len(p))
        _, _, r = search_strip(u, v, w, k, block)
        d = np.repeat(np.maximum(abs(u[:, None] - u), abs(v[:, None] - v)), w, axis=1)
        want = [np.sort(row)[k] if len(row) > k else np.inf for row in d]
        np.testing.assert_allclose(r, want)


def test_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, float("nan"), 1.0), (3.0, 1.0, 1.0)], "a double, b double, c double")
    assert neighbour_information(df, [("a", "b")], 3).first().mi is None
    assert neighbour_information(df.where("false"), [("a", "b")], 3).first().mi is None
    same = spark.createDataFrame([(1.0, 2.0)] * 9 + [(2.0, 3.0)] * 9, "a double, b double")
    assert neighbour_information(same, [("a", "b")], 3).first().mi == pytest.approx(brute(np.repeat([1.0, 2.0], 9), np.repeat([2.0, 3.0], 9), 3), abs=1e-9)
    assert DIGAMMA[14] == pytest.approx(psi(15))
