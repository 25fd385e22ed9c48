import itertools
import math
import random

import pytest

from truegauge.functions.exact import rank_sum_p, touch_probability
from truegauge.operators import association, diagnostics


def gap(order, n, m):
    """Largest distance of the two distribution functions, times n m."""
    i = j = most = 0
    for first in order:
        i, j = i + first, j + (not first)
        most = max(most, abs(i * m - j * n))
    return most


@pytest.mark.parametrize("n,m", [(1, 1), (1, 5), (4, 3), (5, 5), (8, 8), (3, 8)])
def test_gap_law_by_all_orders(n, m):
    gaps = [gap([k in chosen for k in range(n + m)], n, m) for chosen in itertools.combinations(range(n + m), n)]
    for g in sorted({0, *gaps, n * m + 1}):
        want = sum(x >= g for x in gaps) / len(gaps)
        assert touch_probability(n, m, g) == pytest.approx(want, abs=1e-14) and touch_probability(m, n, g) == pytest.approx(want, abs=1e-14)


def test_gap_law_meets_known_values_and_limit():
    assert touch_probability(200, 150, 200 * 150) == pytest.approx(2 / math.comb(350, 150), rel=1e-9)
    lam = 1.2
    d = lam / math.sqrt(4000 * 3000 / 7000)
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 20))
    assert touch_probability(4000, 3000, round(d * 4000 * 3000)) == pytest.approx(limit, rel=0.03)


def by_choices(values, flags):
    ranks = [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]
    seen, n = sum(r for r, f in zip(ranks, flags) if f), sum(flags)
    sums = [sum(c) for c in itertools.combinations(ranks, n)]
    low, high = sum(s <= seen for s in sums) / len(sums), sum(s >= seen for s in sums) / len(sums)
    return min(1.0, 2 * min(low, high))


def test_rank_sum_by_all_choices(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g, (n, kinds) in enumerate([(2, 9), (7, 3), (10, 5), (12, 99), (16, 6), (9, 1)]):
        values = [float(rng.randint(0, kinds)) if kinds > 1 else 1.0 for _ in range(n)]
        flags = [True] + [rng.random() < 0.5 for _ in range(n - 2)] + [False]
        rows += [(g, x, f) for x, f in zip(values, flags)]
        want[g] = by_choices(values, flags)
    rows += [(50, 1.0, True), (50, 2.0, True), (51, None, True), (51, 3.0, None), (51, 4.0, True), (None, 1.0, True), (None, 2.0, False)]
    rows += [(60, float(i // 2), i % 3 == 0) for i in range(200)]
    got = {r.g: r for r in association.rank_sum_test(spark.createDataFrame(rows, "g int, x double, f boolean"), "x", "f", ["g"]).collect()}
    for g, p in want.items():
        assert got[g].exact and got[g].p_value == pytest.approx(p, abs=1e-12)
    assert got[50].p_value is None and got[50].z is None and got[5].z is None
    assert (got[51].n_first, got[51].n_rest, got[51].p_value) == (1, 1, 1.0) and got[None].p_value == 1.0
    a, b = 67, 133
    u = sum((x < y) + 0.5 * (x == y) for x in [i // 2 for i in range(200) if i % 3] for y in [i // 2 for i in range(200) if i % 3 == 0])
    z = (abs(u - a * b / 2) - 0.5) / math.sqrt(a * b / 12 * (201 - 100 * 6 / (200 * 199)))
    assert not got[60].exact and got[60].u == u and got[60].z == pytest.approx(max(z, 0)) and got[60].p_value == pytest.approx(min(1, math.erfc(max(z, 0) / math.sqrt(2))))
    none = spark.createDataFrame([], "g int, x double, f boolean")
    assert association.rank_sum_test(none, "x", "f", ["g"]).collect() == []


def test_rank_sum_p_edges():
    assert math.isnan(rank_sum_p([], [])) and math.isnan(rank_sum_p([2, 1], [2, 1])) and rank_sum_p([5], [2]) == 1.0
    assert rank_sum_p([1] * 60, [1] * 30 + [0] * 30) == pytest.approx(2 / math.comb(60, 30), rel=1e-9)


def test_exact_gap_of_groups(spark):
    rng = random.Random(7)
    rows = [(g, rng.random() + shift * r, "ab"[r]) for g, (n, m, shift) in enumerate([(8, 6, 0), (5, 5, 3), (7, 1, 0)]) for r in range(2) for _ in range((n, m)[r])]
    df = spark.createDataFrame(rows, "g int, x double, r string")
    for row in diagnostics.two_sample_ks(df, "x", "r", "a", ["g"], min_rows=1, exact=True).collect():
        n, m = row.n_first, row.n_second
        gaps = [gap([k in c for k in range(n + m)], n, m) for c in itertools.combinations(range(n + m), n)]
        assert row.ks_p == pytest.approx(sum(x >= round(row.ks * n * m) for x in gaps) / len(gaps), abs=1e-13)
    assert [r.ks_p for r in diagnostics.two_sample_ks(df, "x", "r", "a", ["g"], min_rows=9, exact=True).collect()] == [None] * 3
