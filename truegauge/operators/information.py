"""Mutual information of continuous columns by nearest neighbours.

The estimate compares, for every row, the distance to its k-th nearest neighbour in the plane (the larger of the two
coordinates' distances, each in units of its deviation) with the number of rows that are as near in each coordinate alone. Equal rows are one
weighted point. The plane is cut into strips of equally many points along the first coordinate. Inside its strip, sorted
by the second, a point finds its neighbours in a block and then, where its square crosses the block's ends, in the strip; only points whose square
reaches over a strip's border visit others. A strip holds about ``sqrt(points * BLOCK)`` points, whatever the data's density, and that is
the most a task holds. The counts along one coordinate are differences of running totals along the order of the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.lookup import attach
from truegauge.operators.ordered import running_totals, with_ordinal
from truegauge.session import materialise

#: Points that search their neighbours among each other at once.
BLOCK = 512
#: Distances that differ by less than this share are equal.
SAME = 1e-9
#: digamma at 1 .. 15; beyond, its series is right to 1e-15.
DIGAMMA = [-0.57721566490153286 + sum(1 / j for j in range(1, n)) for n in range(1, 16)]


def digamma(n: Column) -> Column:
    """digamma of whole numbers from 1 on."""
    x = n.cast("double")
    y = 1 / (x * x)
    series = F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return F.when(n <= len(DIGAMMA), F.get(F.array(*[F.lit(v) for v in DIGAMMA]), (n - 1).cast("int"))).otherwise(series)


def nearest(u: np.ndarray, v: np.ndarray, w: np.ndarray, at_u: np.ndarray, at_v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and weights of the ``most`` nearest of the points to every place, nearest first."""
    d = np.maximum(abs(at_u[:, None] - u), abs(at_v[:, None] - v))
    most = min(most, len(u))
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    far = np.take_along_axis(d, near, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    return np.take_along_axis(far, order, axis=1), w[near]


def reach(distance: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """First distance within which the weights reach ``k``, infinite if they don't."""
    run = np.cumsum(weight, axis=1)
    enough = run >= k
    first = enough.argmax(axis=1)
    return np.where(enough.any(axis=1), np.take_along_axis(distance, first[:, None], axis=1)[:, 0], np.inf)


def search_strip(u: np.ndarray, v: np.ndarray, w: np.ndarray, k: int, block: int = BLOCK) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per point of a strip (sorted by ``v``) the distances and weights of its nearest neighbours, itself less one copy, and the distance of the k-th."""
    n = len(u)
    cuts = [n * i // max(1, n // block) for i in range(max(1, n // block) + 1)]
    far, weight, r = [], [], np.empty(n)
    for a, b in zip(cuts, cuts[1:]):
        d, c = nearest(u[a:b], v[a:b], w[a:b], u[a:b], v[a:b], k + 1)
        c[:, 0] -= 1  # points are distinct, so the nearest is the point itself
        own = reach(d, c, k)
        low, high = v[a:b] - own, v[a:b] + own
        cross = ((low < v[a - 1]) if a else np.zeros(b - a, bool)) | ((high > v[b]) if b < n else np.zeros(b - a, bool))
        for i in np.flatnonzero(cross):
            slack = SAME * (own[i] + abs(u[a + i]) + abs(v[a + i]))  # the k-th neighbour itself must not be lost to rounding
            s, e = np.searchsorted(v, low[i] - slack, side="left"), np.searchsorted(v, high[i] + slack, side="right")
            inside = np.arange(s, e)[abs(u[s:e] - u[a + i]) <= own[i] + slack]
            dd, cc = nearest(u[inside], v[inside], w[inside], u[a + i : a + i + 1], v[a + i : a + i + 1], k + 1)
            cc[:, 0] -= 1
            own[i] = reach(dd, cc, k)[0]
            d[i], c[i] = np.inf, 0
            d[i, : dd.shape[1]], c[i, : dd.shape[1]] = dd[0], cc[0]
        far += list(d)
        weight += list(c)
        r[a:b] = own
    return far, weight, r


def _grouped(batches, keys: int):
    """(key values, columns as arrays) of consecutive rows with equal leading columns."""
    held, last = [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = np.stack([columns[i].astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield last, [np.concatenate(c) for c in zip(*held)]
                held = []
            last = now
            held.append([c[a:b] for c in columns[keys:]])
    if held:
        yield last, [np.concatenate(c) for c in zip(*held)]


def _neighbour_distances(points: DataFrame, k: int, block: int) -> DataFrame:
    """(_p, u, v, w, rho): the distance of every weighted point to its k-th neighbour, exact."""
    counts = points.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    strips = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("_n") / block)))
    placed = attach(with_ordinal(points, ["u", "v"], ["_p"], "_i"), counts, ["_p"])
    placed = materialise(placed.select("_p", F.floor(F.col("_i") * strips / F.col("_n")).alias("_s"), "v", "u", "w"), "strips")
    # One row a strip: the root of the number of points in all.
    edge = placed.groupBy("_p", "_s").agg(F.min("u").alias("low"), F.max("u").alias("high")).orderBy("_p", "_s").collect()
    edges = {p: tuple(np.array([(r.low, r.high) for r in edge if r["_p"] == p]).T) for p in {r["_p"] for r in edge}}
    sent = points.sparkSession.sparkContext.broadcast(edges)

    def own(batches):
        for (p, s), (v, u, w) in _grouped(batches, 2):
            far, weight, r = search_strip(u, v, w, k, block)
            low, high = sent.value[p]
            # Strips whose points may be nearer than the k-th of the own strip.
            first = np.minimum(np.searchsorted(high, u - r, side="right"), s)
            last = np.maximum(np.searchsorted(low, u + r, side="left") - 1, s)
            n = len(u)
            for a in range(0, n, 10_000):
                b = min(n, a + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, p)), *[pa.array(x[a:b]) for x in (u, v, w, r)], pa.array([x.tolist() for x in far[a:b]], pa.list_(pa.float64())),
                        pa.array([x.tolist() for x in weight[a:b]], pa.list_(pa.int64())), pa.array(np.full(b - a, s)), pa.array(first[a:b]), pa.array(last[a:b]),
                    ],
                    names=["_p", "u", "v", "w", "r", "far", "weight", "_own", "first", "last"],
                )

    by_strip = placed.repartition("_p", "_s").sortWithinPartitions("_p", "_s", "v", "u")
    found = materialise(by_strip.mapInArrow(own, "_p long, u double, v double, w long, r double, far array<double>, weight array<long>, _own long, first long, last long"), "near")
    visits = found.where("first < last").select("_p", F.explode(F.sequence("first", "last")).alias("_s"), "v", "u", "r", "_own").where("_s <> _own")

    def other(batches):
        strip: tuple | None = None
        for (p, s, kind), (v, u, w, r) in _pieces(batches):
            if not kind:
                strip = (p, s, u, v, w)
                continue
            if strip is None or strip[:2] != (p, s):
                continue
            _, _, pu, pv, pw = strip
            start, end = np.searchsorted(pv, v - r, side="left"), np.searchsorted(pv, v + r, side="right")
            rows = []
            for i in range(len(u)):
                inside = np.arange(start[i], end[i])
                inside = inside[abs(pu[inside] - u[i]) <= r[i]]
                if len(inside):
                    d, c = nearest(pu[inside], pv[inside], pw[inside], u[i : i + 1], v[i : i + 1], k)
                    rows.append((p, u[i], v[i], d[0].tolist(), c[0].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["_p", "u", "v", "far", "weight"])

    long = lambda df, kind, w, r: df.select("_p", "_s", F.lit(kind).cast("long").alias("_kind"), "v", "u", w.alias("w"), r.alias("r"))
    both = long(placed, 0, F.col("w"), F.lit(0.0)).unionByName(long(visits, 1, F.lit(0).cast("long"), F.col("r")))
    more = both.repartition("_p", "_s").sortWithinPartitions("_p", "_s", "_kind", "v", "u").mapInArrow(other, "_p long, u double, v double, far array<double>, weight array<long>")
    settled = found.where("first >= last").select("_p", "u", "v", "w", F.col("r").alias("rho"))
    lists = found.where("first < last").select("_p", "u", "v", "w", "far", "weight").unionByName(more, allowMissingColumns=True)
    joined = lists.groupBy("_p", "u", "v").agg(F.max("w").alias("w"), F.sort_array(F.flatten(F.collect_list(F.arrays_zip("far", "weight")))).alias("_l"))
    step = lambda s, x: F.struct(
        (s["run"] + x["weight"]).alias("run"), F.when((s["run"] < k) & (s["run"] + x["weight"] >= k), x["far"]).otherwise(s["rho"]).alias("rho")
    )
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(math.inf).alias("rho"))
    return settled.unionByName(joined.select("_p", "u", "v", "w", F.aggregate("_l", start, step)["rho"].alias("rho")))


def _pieces(batches):
    """Like :func:`_grouped` over (pair, strip, kind): a strip's points come whole, visitors batch by batch."""
    held, last = [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = np.stack([columns[i].astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield last, [np.concatenate(c) for c in zip(*held)]
                held = []
            if now[2]:
                yield now, [c[a:b] for c in columns[3:]]
                continue
            last = now
            held.append([c[a:b] for c in columns[3:]])
    if held:
        yield last, [np.concatenate(c) for c in zip(*held)]


def _within(points: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the weight of all points whose ``value`` is nearer than ``rho`` (equal, where that is 0), the point itself included."""
    radius = F.col("rho") * (1 - SAME)
    place = lambda at, tie, sign, w, own: F.struct(at.alias("_at"), F.lit(tie).alias("_tie"), F.lit(sign).alias("_sign"), w.alias("_w"), own.alias("_own"))
    none, mine = F.lit(None).cast("struct<u:double,v:double>"), F.struct("u", "v")
    zero = F.lit(0).cast("long")
    marks = F.array(  # at equal values: lower ends, then points, then upper ends
        place(F.col(value) - radius, 0, -1, zero, mine), place(F.col(value), 1, 0, F.col("w"), none), place(F.col(value) + radius, 2, 1, zero, mine)
    )
    long = points.select("_p", F.inline(marks)).withColumns({"_u": F.col("_own.u"), "_v": F.col("_own.v")}).drop("_own")
    run = running_totals(long, ["_p"], ["_at", "_tie", "_u", "_v"], {"_upto": F.col("_w")})
    counts = run.where("_sign <> 0").groupBy("_p", F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.sum(F.col("_sign") * F.col("_upto")).alias(out))
    return points.join(counts, ["_p", "u", "v"])


def neighbour_information(df: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 3, block: int = BLOCK) -> DataFrame:
    """``(a, b, mi)`` of every pair of columns: the k-nearest-neighbour estimate of their mutual information in nats, never below 0.

    Rows with a missing or NaN value in any of the columns take no part. Rows count as near in a coordinate when nearer than the k-th neighbour; where at least ``k`` others equal a row, its
    equals are its neighbours. A constant column has information 0, fewer than ``k + 1`` rows none (NULL).
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(columns)]).na.drop("any")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(f"_c{i}").alias(f"{s}{i}") for i in range(len(columns)) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    at = {c: i for i, c in enumerate(columns)}
    varies = lambda c: stats["n"] > 0 and stats[f"s{at[c]}"] > 1e-10
    use = [i for i, (a, b) in enumerate(pairs) if stats["n"] > k and varies(a) and varies(b)]
    names = [(i, a, b, None if stats["n"] <= k else 0.0) for i, (a, b) in enumerate(pairs)]
    table = df.sparkSession.createDataFrame(names, "_p long, a string, b string, _plain double")
    if not use:
        return table.select("a", "b", F.col("_plain").alias("mi"))
    scaled = lambda c: (F.col(f"_c{at[c]}") - F.lit(stats[f"m{at[c]}"])) / F.lit(stats[f"s{at[c]}"]) + F.lit(0.0)
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("_p"), scaled(pairs[i][0]).alias("u"), scaled(pairs[i][1]).alias("v")) for i in use])))
    points = materialise(long.groupBy("_p", "u", "v").agg(F.count(F.lit(1)).alias("w")), "points")
    found = materialise(_neighbour_distances(points, k, block), "rho")
    both = _within(materialise(_within(found, "u", "cu"), "within"), "v", "cv")
    near = F.when(F.col("rho") > 0, F.lit(k).cast("long")).otherwise(F.col("w"))
    term = F.col("w") * (digamma(near) - digamma(F.col("cu")) - digamma(F.col("cv")))
    mi = both.groupBy("_p").agg(F.greatest(F.lit(0.0), digamma(F.lit(stats["n"])) + F.sum(term) / stats["n"]).alias("_mi"))
    return table.join(mi, "_p", "left").select("a", "b", F.coalesce("_mi", "_plain").alias("mi"))


def information_matrix(df: DataFrame, columns: Sequence[str], k: int = 3, block: int = BLOCK) -> DataFrame:
    """``(a, b, mi)`` for all pairs in both directions; 0 for a column with itself."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    half = materialise(neighbour_information(df, pairs, k, block), "information")
    same = df.sparkSession.createDataFrame([(c, c, 0.0) for c in columns], half.schema)
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi")).unionByName(same)
