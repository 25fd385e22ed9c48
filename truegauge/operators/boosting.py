"""Histogram gradient boosting for one table or for all its groups at once.

Features are binned once, by quantiles of each group. A tree grows level by level: gradient sums by (group, node, feature, bin) are combined before the
shuffle, whose size depends on groups, nodes, features and bins, not on rows; a pass over the bins finds the best split of every node of a
group. So a thousand groups take as many jobs as ten. Missing values go to the side that gains more. Bounds are handed
down below splits on constrained features, so every tree, and with it the sum, is monotone in them. Losses whose best leaf value is
a quantile (absolute, quantile) set it from a second aggregate over the leaves. Trees are small tables,
written to the shared folder where there are many; scores are written there after every tree, which keeps plans short and lost executors cheap.

Groups whose binned rows fit into a task's memory are dealt to tasks, which grow all their trees by the same steps without a job a level: hundreds of rounds cost their arithmetic,
not their jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.lookup import attach
from truegauge.session import discard, materialise
from truegauge.spec import ModelParams

#: Bins per feature, rows a leaf needs and weight a side needs (those of the published method).
BINS, LEAST_ROWS, LEAST_WEIGHT = 255, 20, 1e-3
#: Share of the losses below which a gain is taken for rounding (rows of one sign have equal gradients, so nothing is gained by parting them).
NOISE = 1e-12
#: Points at which a leaf's residuals are summarised, and the accuracy of quantile sketches.
POINTS, ACCURACY = 255, 10_000
#: Sums (groups x nodes x features x bins) up to which the splits are sought on the driver. Beyond, groups are dealt over tasks; the results are the same.
NEAR_CELLS = 1 << 20
#: Bytes of binned rows that a task may hold to grow all trees of a group. Larger groups grow level by level, in the same way; leaf quantiles are then from sketches.
WHOLE_BYTES = 352 << 20
#: Rows summed at once, and cells of a level whose splits are sought at once, in a task that holds a group.
CHUNK, CHUNK_CELLS = 1 << 17, 1 << 17
#: A model up to this size is sent to every task; a larger one is joined to the rows.
MODEL_BYTES = 64 << 20
SPLIT = "struct<feature:int,bin:int,missing_left:boolean>"
TREE = "array<struct<feature:int,threshold:double,missing_left:boolean,value:double,cover:double>>"


@dataclass(frozen=True)
class Loss:
    """``squared``, ``absolute`` or ``quantile`` of a level."""

    kind: str = "absolute"
    level: float = 0.5

    def __post_init__(self):
        if self.kind not in ("squared", "absolute", "quantile"):
            raise ValueError(f"unknown loss {self.kind}")

    def gradient(self, y: Column, f: Column) -> Column:
        if self.kind == "squared":
            return f - y
        if self.kind == "absolute":
            return F.signum(f - y)
        return F.when(f >= y, 1 - self.level).otherwise(-self.level)

    @property
    def by_quantile(self) -> bool:
        return self.kind != "squared"


def _sketch(rows: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """(keys..., ``_q``, ``_a``): mergeable quantile sketches, one per class of nearly equal weights (an eighth of a doubling), and the classes' weights."""
    probs = F.array(*[F.lit((k + 0.5) / POINTS) for k in range(POINTS)])
    classed = rows.select(*keys, value.alias("_v"), weight.alias("_a")).withColumn("_class", F.round(F.log2("_a") * 8))
    return classed.groupBy(*keys, "_class").agg(F.percentile_approx("_v", probs, ACCURACY).alias("_q"), F.sum("_a").alias("_a")).drop("_class")


def weighted_quantile(sketches: Sequence[np.ndarray], weights: Sequence[float], level: float) -> float:
    """First value at which the running weight reaches ``level`` of all; every value of a class's sketch stands for an equal part of the class's weight.
    Its rank is off by at most one part in ``2 * POINTS`` and the sketches' own error."""
    value = np.concatenate(sketches)
    part = np.concatenate([np.full(len(q), a / len(q)) for q, a in zip(sketches, weights)])
    order = np.argsort(value, kind="stable")
    run = np.cumsum(part[order])
    return float(value[order][min(np.searchsorted(run, run[-1] * (level - 1e-9)), len(run) - 1)])


def bin_edges(rows: DataFrame, features: Sequence[str], by: Sequence[str], bins: int = BINS) -> list[Column]:
    """Aggregates of the distinct upper edges of each feature's bins, at equal shares of the rows that have it."""
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return [F.array_distinct(F.coalesce(F.percentile_approx(c, probs, ACCURACY), F.array().cast("array<double>"))).alias(f"_e{i}") for i, c in enumerate(features)]


def binned(rows: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """``_bins``: per feature the number of edges below its value, -1 if it is missing. A value on an edge belongs below it."""
    step = 1 << max(0, (bins - 1).bit_length() - 1)
    at = {f"_b{i}": F.lit(0) for i in range(len(features))}
    rows = rows.withColumns(at)
    while step:
        rows = rows.withColumns(
            {f"_b{i}": F.when(F.get(f"_e{i}", F.col(f"_b{i}") + (step - 1)) < F.col(c), F.col(f"_b{i}") + step).otherwise(F.col(f"_b{i}")) for i, c in enumerate(features)}
        )
        step //= 2
    return rows.withColumn("_bins", F.array(*[F.when(F.col(c).isNull(), -1).otherwise(F.col(f"_b{i}")).cast("short") for i, c in enumerate(features)]))


def _walked(rows: DataFrame, steps: int) -> DataFrame:
    """``_node`` after ``steps`` from the root by ``_splits``; it stays where no split is."""
    rows = rows.withColumn("_node", F.lit(0))
    for _ in range(steps):
        split = F.get("_splits", F.col("_node"))
        b = F.get("_bins", split["feature"])
        left = F.when(b < 0, split["missing_left"]).otherwise(b <= split["bin"])
        rows = rows.withColumn("_node", F.when(split.isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(left, 1).otherwise(2)))
    return rows


class _Near:
    """Groups few enough for the driver, by number (``_slot``): rows are binned, walked down a tree and summed by array operations on Arrow batches. As expressions, these steps
    outgrow what the engine compiles."""

    def __init__(self, edges: list[list[np.ndarray]], rates: np.ndarray, features: int, nodes: int):
        self.edges, self.rates, self.features, self.nodes = edges, rates, features, nodes
        self.session: SparkSession = SparkSession.active()

    def _sent(self, *arrays):
        return self.session.sparkContext.broadcast(arrays)

    def binned(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        """``_bins`` as :func:`binned` makes them."""
        sent = self._sent(self.edges)

        @F.arrow_udf(T.ArrayType(T.ShortType()))
        def run(slot: pa.Array, *columns: pa.Array) -> pa.Array:
            (edges,), slot = sent.value, slot.to_numpy(zero_copy_only=False)
            out = np.full((len(slot), len(columns)), -1, dtype=np.int16)
            for s in np.unique(slot).tolist():
                own = slot == s
                for i, c in enumerate(columns):
                    x = c.to_numpy(zero_copy_only=False)[own]
                    out[own, i] = np.where(np.isnan(x), -1, np.searchsorted(edges[s][i], x, side="left"))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

        return rows.withColumn("_bins", run("_slot", *features))

    def _splits(self, trees: DataFrame) -> tuple[np.ndarray, ...]:
        """Feature (-1 without split), bin and missing side of every (slot, node), and what its value adds to a score."""
        shape = (len(self.rates), self.nodes)
        feature, bin_, left, value = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape)
        for r in trees.select("_slot", "_splits", "_value").collect():
            for v, (split, x) in enumerate(zip(r["_splits"], r["_value"])):
                if split is not None:
                    feature[r["_slot"], v], bin_[r["_slot"], v], left[r["_slot"], v] = split
                if x is not None:
                    value[r["_slot"], v] = self.rates[r["_slot"]] * x
        return feature, bin_, left, value

    def walked(self, rows: DataFrame, trees: DataFrame, steps: int) -> DataFrame:
        """``_node`` as :func:`_walked` finds it, and ``_step``, what the tree adds to the score there."""
        sent = self._sent(*self._splits(trees))

        @F.arrow_udf("struct<node:int,step:double>")
        def run(slot: pa.Array, bins: pa.Array) -> pa.Array:
            *splits, value = sent.value
            slot, bins = slot.to_numpy(zero_copy_only=False), _matrix(bins)
            node = _descended(slot, bins, *splits, steps)
            return pa.StructArray.from_arrays([pa.array(node.astype(np.int32)), pa.array(value[slot, node])], ["node", "step"])

        return rows.withColumn("_at", run("_slot", "_bins")).withColumns({"_node": F.col("_at")["node"], "_step": F.col("_at")["step"]}).drop("_at")

    def histograms(self, rows: DataFrame, trees: DataFrame, gradient: Column, level: int, bins: int) -> DataFrame:
        """Sums as :func:`histograms` makes them, of the nodes of one level: one array of sums a task, whose size is that of all cells of the level."""
        sent = self._sent(*self._splits(trees)) if level else None
        first, width, d, groups = (1 << level) - 1, 1 << level, self.features, len(self.rates)
        size = groups * width * d * (bins + 1)

        def run(batches):
            g, h, n = np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int64)
            for batch in batches:
                slot, at = batch.column("_slot").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column("_bins"))
                node = _descended(slot, at, *sent.value[:3], level) if level else np.zeros(len(slot), dtype=np.int64)
                own = np.flatnonzero(node >= first)
                code = ((((slot * width + node - first) * d)[own, None] + np.arange(d)) * (bins + 1) + at[own] + 1).ravel()
                for out, part in ((g, "_g"), (h, "_w")):
                    value = np.repeat(batch.column(part).to_numpy(zero_copy_only=False)[own], d)
                    if size > 4 * len(code):
                        np.add.at(out, code, value)
                    else:
                        out += np.bincount(code, value, size)
                if size > 4 * len(code):
                    np.add.at(n, code, 1)
                else:
                    n += np.bincount(code, minlength=size)
            cell = np.flatnonzero(n)
            rest, bin_ = np.divmod(cell, bins + 1)
            rest, feature = np.divmod(rest, d)
            slot, node = np.divmod(rest, width)
            columns = {"_slot": slot.astype(np.int32), "_node": (node + first).astype(np.int32), "_feature": feature.astype(np.int32), "_bin": (bin_ - 1).astype(np.int16), "_g": g[cell], "_h": h[cell], "_c": n[cell]}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

        part = rows.select("_slot", "_bins", (gradient * F.col("_w")).alias("_g"), "_w").mapInArrow(run, "_slot int, _node int, _feature int, _bin short, _g double, _h double, _c long")
        return part.groupBy("_slot", "_node", "_feature", "_bin").agg(*[F.sum(c).alias(c) for c in ("_g", "_h", "_c")])


def _matrix(lists) -> np.ndarray:
    """Lists of equal length as the rows of an array."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1).astype(np.int64) if len(lists) else np.zeros((0, 1), dtype=np.int64)


def _descended(slot: np.ndarray, bins: np.ndarray, feature: np.ndarray, bin_: np.ndarray, missing_left: np.ndarray, steps: int) -> np.ndarray:
    """Nodes of the rows after ``steps`` from the root; a row stays where no split is."""
    node, rows = np.zeros(len(slot), dtype=np.int64), np.arange(len(slot))
    for _ in range(steps):
        f = feature[slot, node]
        b = bins[rows, f]
        left = np.where(b < 0, missing_left[slot, node], b <= bin_[slot, node])
        node = np.where(f < 0, node, 2 * node + 2 - left)
    return node


def histograms(rows: DataFrame, by: Sequence[str], gradient: Column, d: int) -> DataFrame:
    """Sums of gradient, weight and rows by (group, ``_node``, feature, bin): combined in every task, then one shuffle of at most groups x
    nodes x features x (bins + 1) rows a task."""
    long = rows.select(*by, "_node", (gradient * F.col("_w")).alias("_g"), "_w", F.posexplode("_bins").alias("_feature", "_bin"))
    return long.groupBy(*by, "_node", "_feature", "_bin").agg(F.sum("_g").alias("_g"), F.sum("_w").alias("_h"), F.count(F.lit(1)).alias("_c"))


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, signs: Sequence[int], least_rows: int = LEAST_ROWS, l2: float = 0.0):
    """Best split of every node that gains by one, from sums by (node, feature, bin), missing values first.

    Returns (found, feature, bin, missing to the left, value left, value right, rows left, rows right, gain), one entry a node. The value of a side is ``-g / h`` within the
    bounds ``low`` and ``high`` of its node, its loss ``g * value``. ``signs`` are 1, -1 or 0 per feature. Equal gains go to the smaller
    feature, then the smaller bin, then missing values to the right. Without missing values in training, later ones go to the side with more rows.
    """
    total = [x.sum(axis=2)[:, :, None, None] for x in (g, h, n)]
    none = [x[:, :, :1] for x in (g, h, n)]
    # (node, feature, bin, 0: missing right, 1: missing left); the second only where rows miss a value.
    sides = 1 + bool(none[2].any())
    left = [np.stack([c, c + o][:sides], axis=3) for c, o in ((np.cumsum(x[:, :, 1:], axis=2), o) for x, o in zip((g, h, n), none))]
    right = [t - x for t, x in zip(total, left)]
    lo, hi = low[:, None, None, None], high[:, None, None, None]
    sign = np.asarray(signs)[None, :, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        value = lambda x: np.clip(-x[0] / (x[1] + l2), lo, hi)
        a, b = value(left), value(right)
        before, after = total[0] * value(total), left[0] * a + right[0] * b
        gain = before - after
        ok = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_WEIGHT) & (right[1] >= LEAST_WEIGHT) & (gain > NOISE * (abs(before) + abs(after))) & (sign * (b - a) >= 0)
    ok[:, :, :, 1:] &= none[2][:, :, :, None] > 0
    gain = np.where(ok, gain, -np.inf)
    # Sums of doubles depend on their order in the last digits; equal gains must not.
    most = gain.reshape(len(g), -1).max(axis=1)[:, None]
    rank = np.where(ok.reshape(len(g), -1), np.round(gain.reshape(len(g), -1) / np.where(most > 0, most, 1), 12), -np.inf)
    best = rank.argmax(axis=1)
    rows = np.arange(len(g))
    pick = lambda x: x.reshape(len(g), -1)[rows, best]
    feature, rest = np.divmod(best, left[0].shape[2] * sides)
    with_none = none[2][rows, feature, 0] > 0
    to_left = np.where(with_none, rest % sides == 1, pick(left[2]) > pick(right[2]))
    return np.isfinite(rank[rows, best]), feature, rest // sides, to_left, pick(a), pick(b), pick(left[2]), pick(right[2]), pick(gain)


class _Grove:
    """All rows of one group in a task, and the steps that grow its trees there."""

    def __init__(self, coded: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int, base: float, rate: float):
        self.bins, self.y, self.w, self.width, self.rate = coded, y, w, bins + 1, rate
        self.plain = bool((w == 1).all())
        self.f = np.full(len(y), base)

    def gradient(self, a: int, b: int, loss: Loss) -> np.ndarray:
        y, f = self.y[a:b], self.f[a:b]
        if loss.kind == "squared":
            g = f - y
        elif loss.kind == "absolute":
            g = np.sign(f - y)
        else:
            g = np.where(f >= y, 1 - loss.level, -loss.level)
        return g if self.plain else g * self.w[a:b]

    def sums(self, node: np.ndarray, place: np.ndarray, count: int, loss: Loss) -> list[np.ndarray]:
        """Gradient, weight and rows by (live node, feature, bin)."""
        d, size = len(self.bins), count * self.width
        g, h, n = np.zeros((d, size)), np.zeros((d, size)), np.zeros((d, size), dtype=np.int64)
        for a in range(0, len(node), CHUNK):
            b = min(a + CHUNK, len(node))
            at = place[node[a:b]]
            own = None if (at >= 0).all() else np.flatnonzero(at >= 0)
            kept = (lambda x: x) if own is None else lambda x: x[own]
            at, gradient, weight = kept(at) * self.width, kept(self.gradient(a, b, loss)), kept(self.w[a:b])
            for i in range(d):
                code = at + kept(self.bins[i, a:b])
                g[i] += np.bincount(code, gradient, size)
                n[i] += np.bincount(code, minlength=size)
                if not self.plain:
                    h[i] += np.bincount(code, weight, size)
        if self.plain:
            h = n.astype(float)
        return [x.reshape(d, count, self.width).transpose(1, 0, 2).astype(float) for x in (g, h, n)]

    def descend(self, node: np.ndarray, place: np.ndarray, feature: np.ndarray, bin_: np.ndarray, missing_left: np.ndarray) -> None:
        """One step down, in place, for the rows of nodes that were split."""
        flat, rows = self.bins.reshape(-1), self.bins.shape[1]
        for a in range(0, len(node), CHUNK):
            v = node[a : a + CHUNK].astype(np.int64)
            own = np.flatnonzero((place[v] >= 0) & (feature[v] >= 0))
            v = v[own]
            b = flat[feature[v] * rows + (a + own)].astype(np.int64) - 1
            node[a + own] = 2 * v + 2 - np.where(b < 0, missing_left[v], b <= bin_[v])

    def quantiles(self, node: np.ndarray, classes: np.ndarray, count: int, level: float) -> dict[int, float]:
        """Quantile of the residuals of the rows at every leaf, by the points of :func:`_sketch`, which are exact here."""
        code = node.astype(np.int32) * count + classes
        code = code.astype(np.uint16) if len(code) and code.max() < 1 << 16 else code
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        shares, parts = (np.arange(POINTS) + 0.5) / POINTS, {}
        for c, a, b in zip(code[first].tolist(), first.tolist(), [*first.tolist()[1:], len(order)]):
            own = order[a:b]
            r = np.sort(self.y[own] - self.f[own])
            parts.setdefault(c // count, []).append((r[np.ceil(shares * (b - a)).astype(np.int64) - 1], self.w[own].sum()))
        return {v: weighted_quantile([q for q, _ in p], [w for _, w in p], level) for v, p in parts.items()}

    def trees(self, rounds: int, depth: int, nodes: int, signs: Sequence[int], loss: Loss, least_rows: int, l2: float):
        """The trees one by one, as arrays in heap order: feature (-1 at leaves), bin, missing side, value (NaN without node) and rows."""
        d, sign = len(self.bins), np.asarray(signs)
        node = np.empty(len(self.y), dtype=np.int16 if nodes < 1 << 15 else np.int32)
        if loss.by_quantile:
            _, classes = np.unique(_weight_class(self.w), return_inverse=True)
            count = int(classes.max()) + 1
            classes = classes.astype(np.uint8 if count < 256 else np.int32)
        for _ in range(rounds):
            none = np.full(nodes, np.nan)
            tree = {"feature": np.full(nodes, -1), "bin": np.zeros(nodes, np.int64), "left": np.zeros(nodes, bool), "value": none.copy(), "cover": none.copy()}
            low, high, value, cover = none.copy(), none.copy(), tree["value"], tree["cover"]
            value[0], cover[0], low[0], high[0] = 0.0, len(self.y), -np.inf, np.inf
            node[:] = 0
            for level in range(depth):
                first = (1 << level) - 1
                # Nodes of fewer rows than two leaves need can't be split.
                live = first + np.flatnonzero(np.nan_to_num(cover[first : 2 * first + 1]) >= max(2 * least_rows, 1))
                if not len(live):
                    break
                place = np.full(nodes, -1)
                place[live] = np.arange(len(live))
                cells, step = self.sums(node, place, len(live), loss), max(1, CHUNK_CELLS // (d * self.width))
                parts = [best_splits(*[x[k : k + step] for x in cells], low[live[k : k + step]], high[live[k : k + step]], signs, least_rows, l2) for k in range(0, len(live), step)]
                ok, feature, bin_, left, a_value, b_value, a_rows, b_rows, _ = (np.concatenate(x) for x in zip(*parts))
                if not ok.any():
                    break
                v = live[ok]
                tree["feature"][v], tree["bin"][v], tree["left"][v] = feature[ok], bin_[ok], left[ok]
                a, b = 2 * v + 1, 2 * v + 2
                value[a], value[b], cover[a], cover[b] = a_value[ok], b_value[ok], a_rows[ok], b_rows[ok]
                low[a], low[b], high[a], high[b] = low[v], low[v], high[v], high[v]
                middle, s = (value[a] + value[b]) / 2, sign[feature[ok]]
                high[a[s > 0]] = low[b[s > 0]] = middle[s > 0]
                high[b[s < 0]] = low[a[s < 0]] = middle[s < 0]
                self.descend(node, place, tree["feature"], tree["bin"], tree["left"])
            if loss.by_quantile:
                for v, x in self.quantiles(node, classes, count, loss.level).items():
                    value[v] = x
            step = self.rate * np.nan_to_num(tree["value"])
            for a in range(0, len(node), CHUNK):
                self.f[a : a + CHUNK] += step[node[a : a + CHUNK]]
            yield tree


def _coded(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray], bins: int) -> np.ndarray:
    """Feature by feature the number of edges below the value and one more, 0 where it is missing."""
    parts = [np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1) for x, e in zip(columns, edges)]
    return np.stack(parts).astype(np.uint8 if bins < 256 else np.uint16)


def _weight_class(w: np.ndarray) -> np.ndarray:
    """Classes of nearly equal weights, as :func:`_sketch` makes them."""
    x = np.log2(w) * 8
    return np.copysign(np.floor(np.abs(x) + 0.5), x) + 0.0


def _row_bytes(d: int, loss: Loss) -> int:
    """Bytes a row takes in a :class:`_Grove`: bins, label, weight, score and node, and its place in the order by leaves."""
    return d + 26 + (25 if loss.by_quantile else 0)


def _parts(sizes: Sequence[int], tasks: int) -> list[int]:
    """Numbers of the tasks that groups of these sizes go to: one each where they are few, else neighbours together."""
    if len(sizes) <= tasks:
        return list(range(len(sizes)))
    most, out, part, used = sum(sizes) / tasks, [], 0, 0
    for size in sizes:
        if used and used + size > most:
            part, used = part + 1, 0
        out.append(part)
        used += size
    return out


def _grown_whole(rows: DataFrame, xs: Sequence[str], facts: list[dict], parts: int, nodes: int, signs: Sequence[int], bins: int, loss: Loss, least_rows: int, l2: float) -> DataFrame:
    """(``_slot``, ``_m``, ``tree``): all trees of every group, grown in the task that ``_part`` names. ``facts`` are edges, base, rate, rounds and depth by slot."""
    sent = rows.sparkSession.sparkContext.broadcast(facts)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            slot, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_slot", *xs, "_y", "_w"))
            for s in np.unique(slot).tolist():
                own = slot == s
                *x, y, w = (c[own].astype(float) for c in columns)
                held.setdefault(s, []).append((_coded(x, sent.value[s]["edges"], bins), y, w))
        for s in sorted(held):
            known, (x, y, w) = sent.value[s], map(list, zip(*held.pop(s)))
            grove = _Grove(np.concatenate(x, axis=1), np.concatenate(y), np.concatenate(w), bins, known["base"], known["rate"])
            del x, y, w
            for m, tree in enumerate(grove.trees(known["rounds"], known["depth"], nodes, signs, loss, least_rows, l2)):
                yield _tree_batch(s, m, tree, known)

    dealt = rows.select("_part", "_slot", *xs, "_y", "_w").repartitionById(parts, "_part").drop("_part")
    return dealt.mapInArrow(run, f"_slot int, _m int, tree {TREE}")


def _tree_batch(slot: int, m: int, tree: dict, known: dict) -> pa.RecordBatch:
    """One tree as a row; the last bin has no edge above it: all values go left, missing ones right."""
    leaf, absent = tree["feature"] < 0, np.isnan(tree["cover"])
    threshold = np.array([np.inf if b >= len(known["edges"][f]) else known["edges"][f][b] for f, b in zip(np.maximum(tree["feature"], 0).tolist(), tree["bin"].tolist())])
    columns = {
        "feature": pa.array(tree["feature"].astype(np.int32), mask=leaf), "threshold": pa.array(threshold, mask=leaf), "missing_left": pa.array(tree["left"], mask=leaf),
        "value": pa.array(known["rate"] * tree["value"], mask=absent), "cover": pa.array(tree["cover"], mask=absent),
    }
    cells = pa.ListArray.from_arrays(pa.array([0, len(leaf)], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([m], pa.int32()), cells], ["_slot", "_m", "tree"])


#: A growing tree of one group as arrays in heap order; NULL where there is no node.
_ROW = ["_splits", "_value", "_n", "_low", "_high"]


def _seedling(groups: DataFrame, by: Sequence[str], nodes: int) -> DataFrame:
    """Trees of one node, whose value is 0."""
    one = lambda c: F.array(c, *[F.lit(None).cast("double")] * (nodes - 1))
    return groups.select(
        *by, "_depth", F.array_repeat(F.lit(None).cast(SPLIT), nodes).alias("_splits"), one(F.lit(0.0)).alias("_value"), one(F.col("_rows").cast("double")).alias("_n"),
        one(F.lit(-math.inf)).alias("_low"), one(F.lit(math.inf)).alias("_high"),
    )


def _per_group(rows: DataFrame, trees: DataFrame, by: Sequence[str], work, near: bool) -> DataFrame:
    """``work(sums, tree)`` for every group: its aggregated ``rows`` and its tree's row (both as Arrow tables) to the tree's new arrays.

    ``near``: the sums of all groups are known to be few and come to the driver, which saves a shuffle and a write a level. Else every group is worked on in a task of its
    own (its sums are bounded by nodes, features and bins) and the trees are written.
    """
    both = trees.withColumn("_is", F.lit(True)).unionByName(rows, allowMissingColumns=True)
    keys = list(by)
    schema = trees.select(*keys, "_depth", *_ROW).schema

    def run(table):
        import pyarrow.compute as pc

        mine = pc.fill_null(table.column("_is"), False)
        tree, sums = table.filter(mine), table.filter(pc.invert(mine))
        if not tree.num_rows:  # sums of a group that grows no tree any more
            return tree.select([*keys, "_depth", *_ROW])
        now = {c: tree.column(c)[0].as_py() for c in _ROW}
        out = tree.select([*keys, "_depth"])
        for c, x in work(sums, now, tree.column("_depth")[0].as_py()).items():
            out = out.append_column(c, pa.array([x], tree.schema.field(c).type))
        return out

    if near:
        table = both.toArrow()
        whole = table.column("_is").fill_null(False).to_numpy()
        group = pd.Series(list(zip(*[table.column(c).to_pylist() for c in keys])) if keys else [()] * table.num_rows, dtype=object)
        number = group.map({k: i for i, k in enumerate(dict.fromkeys(group[whole]))}).fillna(-1).to_numpy(dtype=np.int64)
        order = np.argsort(number, kind="stable")
        table, number = table.take(pa.array(order)), number[order]
        cuts = np.searchsorted(number, np.arange(number[-1] + 2 if len(number) else 1))
        done = [run(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        session = trees.sparkSession
        return session.createDataFrame(pa.concat_tables(done).combine_chunks(), schema) if done else session.createDataFrame([], schema)
    both = both if keys else both.withColumn("_every", F.lit(0))
    return materialise(both.groupBy(*(keys or ["_every"])).applyInArrow(run, schema), "tree")


def _grown(level: int, signs: Sequence[int], bins: int, least_rows: int, l2: float):
    """Adds the splits of one level, and the values and bounds of the nodes below them. The middle of the two values parts the sides of a split on a constrained feature."""
    first, width, d = (1 << level) - 1, 1 << level, len(signs)

    def work(sums, tree: dict, depth: int) -> dict:
        if level >= depth or not sums.num_rows:
            return tree
        sums = sums.filter(pa.compute.greater_equal(sums.column("_node"), first))
        if not sums.num_rows:
            return tree
        col = lambda c: sums.column(c).to_numpy()
        at = (col("_node").astype(np.int64) - first, col("_feature").astype(np.int64), col("_bin").astype(np.int64) + 1)
        cells = []
        for c in ("_g", "_h", "_c"):
            x = np.zeros((width, d, bins + 1))
            np.add.at(x, at, col(c).astype(float))
            cells.append(x)
        low, high = (np.array([tree[c][first + k] if tree[c][first + k] is not None else 0.0 for k in range(width)]) for c in ("_low", "_high"))
        found = best_splits(*cells, low, high, signs, least_rows, l2)
        for k in np.flatnonzero(found[0]).tolist():
            _, f, b, to_left, left, right, n_left, n_right, _ = (x[k].item() for x in found)
            v = first + k
            tree["_splits"][v] = {"feature": f, "bin": b, "missing_left": to_left}
            for child, value, n in ((2 * v + 1, left, n_left), (2 * v + 2, right, n_right)):
                tree["_value"][child], tree["_n"][child], tree["_low"][child], tree["_high"][child] = value, n, tree["_low"][v], tree["_high"][v]
            if signs[f]:
                below, above = (2 * v + 1, 2 * v + 2) if signs[f] > 0 else (2 * v + 2, 2 * v + 1)
                tree["_high"][below] = tree["_low"][above] = (left + right) / 2
        return tree

    return work


def _settled(signs: Sequence[int], level: float):
    """Sets node values to the quantiles of their rows' residuals, within the order that constrained splits demand."""

    def work(sums, tree: dict, depth: int) -> dict:
        node = sums.column("_node").to_numpy()
        q, a = sums.column("_q").to_pylist(), sums.column("_a").to_pylist()
        for v in np.unique(node).tolist():
            own = np.flatnonzero(node == v)
            tree["_value"][v] = weighted_quantile([np.asarray(q[i]) for i in own], [a[i] for i in own], level)
        if any(signs):
            values = np.array([np.nan if x is None else x for x in tree["_value"]])
            done = ordered_values(values, np.array([-1 if s is None else s["feature"] for s in tree["_splits"]]), signs)
            tree["_value"] = [None if np.isnan(x) else float(x) for x in done]
        return tree

    return work


def ordered_values(values: np.ndarray, features: np.ndarray, signs: Sequence[int]) -> np.ndarray:
    """Values of one tree's nodes (heap order, NaN for none; ``features`` -1 at leaves) brought within the bounds that the middles of the sides' values
    set below splits on constrained features."""
    out, low, high = values.copy(), np.full(len(values), -np.inf), np.full(len(values), np.inf)
    for k in range(len(values)):
        out[k] = min(max(out[k], low[k]), high[k])
        f = features[k]
        if f < 0 or 2 * k + 2 >= len(values):
            continue
        a, b = 2 * k + 1, 2 * k + 2
        low[[a, b]], high[[a, b]] = low[k], high[k]
        if signs[f]:
            mid = min(max((values[a] + values[b]) / 2, low[k]), high[k])
            up, down = (b, a) if signs[f] > 0 else (a, b)
            low[up], high[down] = mid, mid
    return out


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), loss: Loss = Loss(), params: ModelParams = ModelParams(), weight: str | None = None,
    monotone: dict[str, int] | None = None, settings: DataFrame | None = None, bins: int = BINS, least_rows: int = LEAST_ROWS, l2: float = 0.0,
) -> BoostedTrees:
    """Boosted trees of every group of ``by`` (NULL is a group too) in one fit.

    ``settings`` may give a group its own ``learning_rate``, ``max_iter`` and ``max_depth`` (columns, NULL for those of ``params``). ``monotone`` names features in which
    predictions may only rise (1) or fall (-1). Rows without label or without positive weight take no part; missing and NaN features are a
    value of their own. Trees are bounded by depth and by ``least_rows`` a leaf.
    """
    by, d = list(by), len(features)
    signs = [(monotone or {}).get(c, 0) for c in features]
    xs = [f"_x{i}" for i in range(d)]
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, *[clean(c).alias(x) for c, x in zip(features, xs)], clean(label).alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.where(F.col("_y").isNotNull() & (F.col("_w") > 0))

    groups = rows.groupBy(*by).agg(*bin_edges(rows, xs, by, bins), F.count(F.lit(1)).alias("_rows"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_mean"))
    groups = groups.where(F.col("_rows") > 0)
    if loss.by_quantile:
        groups = attach(groups, _quantiles(_sketch(rows, by, F.col("_y"), F.col("_w")), by, loss.level, "_base"), by)
    else:
        groups = groups.withColumn("_base", F.col("_mean"))
    own = {"learning_rate": "_rate", "max_iter": "_rounds", "max_depth": "_depth"}
    given = [c for c in own if settings is not None and c in settings.columns]
    if given:
        groups = attach(groups, settings.select(*by, *[F.col(c).alias(f"_own_{c}") for c in given]), by)
    kinds = {"learning_rate": "double", "max_iter": "int", "max_depth": "int"}
    groups = groups.withColumns({n: (F.coalesce(f"_own_{c}", F.lit(getattr(params, c))) if c in given else F.lit(getattr(params, c))).cast(kinds[c]) for c, n in own.items()})
    groups = materialise(groups.drop("_mean", *[f"_own_{c}" for c in given]), "groups")
    rounds, depth, count, most = groups.agg(F.max("_rounds"), F.max("_depth"), F.count(F.lit(1)), F.max("_rows")).first()
    rounds, depth = rounds or 0, depth or 0
    near = count * (1 << depth) * d * (bins + 1) <= NEAR_CELLS
    nodes = (1 << (depth + 1)) - 1

    edges = F.array(*[F.col(f"_e{i}") for i in range(d)])
    keys, small = by, None
    if near:
        # Few groups: they go by number, and their edges and trees to the tasks as arrays.
        got = groups.collect()
        parts = _parts([r["_rows"] for r in got], 4 * groups.sparkSession.sparkContext.defaultParallelism)
        limits = [[np.asarray(r[f"_e{i}"], dtype=float) for i in range(d)] for r in got]
        schema = T.StructType([*[groups.schema[c] for c in by], T.StructField("_slot", T.IntegerType()), T.StructField("_part", T.IntegerType())])
        slots = groups.sparkSession.createDataFrame([(*[r[c] for c in by], i, part) for i, (r, part) in enumerate(zip(got, parts))], schema)
        numbered = lambda df: attach(df, slots, by) if by else df.withColumns({"_slot": F.lit(0), "_part": F.lit(0)})
        # Quantiles that bound those below them stay with the sketches.
        if rounds and got and most * _row_bytes(d, loss) <= WHOLE_BYTES and not (loss.by_quantile and any(signs)):
            facts = [{"edges": e, "base": r["_base"], "rate": r["_rate"], "rounds": r["_rounds"], "depth": r["_depth"]} for e, r in zip(limits, got)]
            grown = _grown_whole(numbered(rows), xs, facts, max(parts) + 1, nodes, signs, bins, loss, least_rows, l2)
            whole = materialise(attach(grown, slots.drop("_part"), ["_slot"]).select(*by, "_m", "tree"), "trees")
            return BoostedTrees(list(features), by, groups.select(*by, F.col("_base").alias("base")), whole, depth)
        small = _Near(limits, np.array([r["_rate"] for r in got], dtype=float), d, nodes)
        rows, groups, keys = numbered(rows), materialise(numbered(groups), "groups"), ["_slot"]

    known = groups.select(*keys, *([] if near else [f"_e{i}" for i in range(d)]), F.col("_base").alias("_f"), "_rounds")
    start = attach(rows, known if by or not near else known.drop("_slot"), keys if by else [])
    kept = [*keys, "_bins", "_y", "_w", "_f", *(["_rounds"] if given else [])]
    state = materialise((small.binned(start, xs) if near else binned(start, xs, bins)).select(*kept), "binned")
    gradient = loss.gradient(F.col("_y"), F.col("_f"))
    trees: list[DataFrame] = []
    for m in range(rounds):
        now = state.where(F.col("_rounds") > m) if given else state
        tree = _seedling(groups.where(F.col("_rounds") > m) if given else groups, keys, nodes)
        walked = small.walked if near else lambda rows, tree, steps: _walked(attach(rows, tree.select(*by, "_splits"), by), steps)
        for level in range(depth):
            # Rows of finished nodes are left out only where their sums are read: as a filter on the rows, the walk would be worked out again for every mention of its result.
            sums = small.histograms(now, tree, gradient, level, bins) if near else histograms(walked(now, tree, level), by, gradient, d)
            tree = _per_group(sums, tree, keys, _grown(level, signs, bins, least_rows, l2), near)
        if loss.by_quantile:
            leaf = walked(now, tree, depth)
            # The values of the sides bound those below them; the root, unless it is a leaf, bounds nothing.
            path = [F.shiftright(F.col("_node") + 1, k) - 1 for k in range(depth + 1)] if any(signs) else None
            spread = leaf.withColumn("_node", F.explode(F.filter(F.array(*path), lambda k, i: (k > 0) | (k == 0) & (i == 0)))) if path else leaf
            tree = _per_group(_sketch(spread, [*keys, "_node"], F.col("_y") - F.col("_f"), F.col("_w")), tree, keys, _settled(signs, loss.level), near)
        trees.append(tree.withColumn("_m", F.lit(m)))
        if m + 1 < rounds:
            if near:
                moved = walked(state, tree, depth).withColumn("_f", F.col("_f") + F.col("_step"))
            else:
                step = attach(tree.select(*by, "_splits", "_value"), groups.select(*by, "_rate"), by)
                moved = _walked(attach(state, step, by), depth).withColumn("_f", F.col("_f") + F.coalesce(F.col("_rate") * F.get("_value", F.col("_node")), F.lit(0.0)))
            past, state = state, materialise(moved.select(*kept), "binned")
            discard(past)
    whole = None
    if trees:
        # The last bin has no edge above it: all values go left, missing ones right.
        limit = lambda split: F.when(split.isNotNull(), F.coalesce(F.get(F.get(edges, split["feature"]), split["bin"]), F.lit(math.inf)))
        cell = lambda i: F.struct(
            F.get("_splits", i)["feature"].alias("feature"), limit(F.get("_splits", i)).alias("threshold"), F.get("_splits", i)["missing_left"].alias("missing_left"), (F.col("_rate") * F.get("_value", i)).alias("value"), F.get("_n", i).alias("cover"),
        )
        known = attach(reduce(DataFrame.unionByName, trees), groups.select(*dict.fromkeys([*keys, *by]), "_rate", *[f"_e{i}" for i in range(d)]), keys)
        whole = materialise(known.select(*by, "_m", F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), cell).alias("tree")), "trees")
    return BoostedTrees(list(features), by, materialise(groups.select(*by, F.col("_base").alias("base")), "base"), whole, depth)


def _quantiles(sketch: DataFrame, by: Sequence[str], level: float, out: str) -> DataFrame:
    """One weighted quantile per group from its sketches."""

    @F.pandas_udf(T.DoubleType())
    def run(sketches: pd.Series) -> pd.Series:
        return pd.Series([weighted_quantile([np.asarray(s["_q"]) for s in group], [s["_a"] for s in group], level) for group in sketches], dtype="float64")

    lists = sketch.groupBy(*by).agg(F.collect_list(F.struct("_q", "_a")).alias("_l")).where(F.size("_l") > 0)
    return lists.select(*by, run("_l").alias(out))


@dataclass
class Forest:
    """All trees of all groups as arrays: (group, tree, node in heap order). ``feature`` is -1 at leaves."""

    base: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int

    def scores(self, slot: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row of ``x`` (NaN for missing), and its group's base."""
        out, (_, trees, nodes) = self.base[slot].copy(), self.feature.shape
        feature, threshold, missing_left, value = (a.reshape(-1) for a in (self.feature, self.threshold, self.missing_left, self.value))
        flat, row, some = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1], bool(np.isnan(x).any())
        for t in range(trees):
            root = (slot.astype(np.int64) * trees + t) * nodes
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = root + node
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                v = flat[row + np.where(inner, f, 0)]
                left = v <= threshold[at]
                if some:
                    left = np.where(np.isnan(v), missing_left[at], left)
                node = np.where(inner, 2 * node + 2 - left, node)
            out += value[root + node]
        return out


@dataclass
class BoostedTrees:
    """A base value per group (``base``) and its trees (``trees``: ``(by..., _m, tree)``), as tables."""

    features: list[str]
    by: list[str]
    base: DataFrame
    trees: DataFrame | None
    depth: int
    _forest: tuple | None = field(default=None, repr=False)

    def size(self) -> int:
        """Bytes of the model as arrays."""
        groups = self.base.count()
        rounds = 1 + (self.trees.agg(F.max("_m")).first()[0] or 0) if self.trees is not None else 0
        return groups * rounds * ((1 << (self.depth + 1)) - 1) * 28

    def forest(self) -> tuple[list[tuple], Forest]:
        """Keys of the groups and the arrays; for models whose :meth:`size` was checked."""
        if self._forest is None:
            base = [tuple(r) for r in self.base.select(*self.by, "base").collect()]
            slot = {r[:-1]: i for i, r in enumerate(base)}
            got = self.trees.select(*self.by, "_m", "tree").toArrow().combine_chunks() if self.trees is not None else None
            rounds = got.column("_m").to_numpy() if got is not None else np.zeros(0, dtype=np.int64)
            shape = (len(base), 1 + int(rounds.max(initial=-1)), (1 << (self.depth + 1)) - 1)
            out = Forest(np.array([r[-1] for r in base], dtype=float), np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape), self.depth)
            if len(rounds):
                keys = zip(*[got.column(c).to_pylist() for c in self.by]) if self.by else [()] * len(rounds)
                at = np.array([slot[k] for k in keys]), rounds
                cells = pa.concat_arrays(got.column("tree").chunks).flatten()
                for name, none in (("feature", -1), ("threshold", np.nan), ("missing_left", False), ("value", 0.0), ("cover", 0.0)):
                    getattr(out, name)[at] = cells.field(name).fill_null(none).to_numpy(zero_copy_only=False).reshape(len(rounds), -1)
            self._forest = [k for *k, _ in base], out
        return self._forest

    def slots(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_slot``, the number of its group in the arrays; NULL for groups without model."""
        keys, _ = self.forest()
        if not self.by:
            return df.withColumn("_slot", F.lit(0 if keys else None).cast("int"))
        schema = T.StructType([*[self.base.schema[c] for c in self.by], T.StructField("_slot", T.IntegerType())])
        return attach(df, df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], schema), self.by)

    def transform(self, df: DataFrame, out: str = "predicted_delta", most: int = MODEL_BYTES) -> DataFrame:
        """Adds the prediction; NULL in groups without model. Up to ``most`` bytes the model goes to every task, else its rows are joined to the rows of their group."""
        missing = [c for c in [*self.by, *self.features] if c not in df.columns]
        if missing:
            raise ValueError(f"missing feature columns: {missing}")
        if self.size() > most:
            return self._joined(df, out)
        # Plain arrays: classes of this package need not be installed where broadcasts are read.
        model = df.sparkSession.sparkContext.broadcast(tuple(vars(self.forest()[1]).values()))

        @F.pandas_udf(T.DoubleType())
        def score(slot: pd.Series, *columns: pd.Series) -> pd.Series:
            known = slot.notna().to_numpy()
            got = np.full(len(slot), np.nan)
            x = np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns], axis=1)[known]
            got[known] = Forest(*model.value).scores(slot[known].to_numpy(dtype="int64"), x)
            return pd.Series(got, index=slot.index).where(known, None)

        scored = self.slots(df).withColumn(out, score("_slot", *[F.col(c).cast("double") for c in self.features]))
        return scored.withColumn(out, F.nanvl(out, F.lit(None).cast("double"))).select(*[c for c in df.columns if c != out], out)

    def _joined(self, df: DataFrame, out: str) -> DataFrame:
        model = self.base
        if self.trees is not None:
            model = attach(model, self.trees.groupBy(*self.by).agg(F.sort_array(F.collect_list(F.struct("_m", "tree"))).alias("_trees")), self.by)
        else:
            model = model.withColumn("_trees", F.lit(None).cast(f"array<struct<_m:int,tree:{TREE}>>"))
        x = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.features])
        rows = attach(df.withColumn("_x", x), model.select(*self.by, "base", "_trees"), self.by)

        def leaf(tree: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                n = F.get(tree, node)
                v = F.get("_x", n["feature"])
                left = F.coalesce(v <= n["threshold"], n["missing_left"])
                return F.when(n["feature"].isNull(), node).otherwise(2 * node + F.when(left, 1).otherwise(2))

            return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(max(1, self.depth))), F.lit(0), step))["value"]

        total = F.aggregate(F.coalesce("_trees", F.array().cast(f"array<struct<_m:int,tree:{TREE}>>")), F.col("base"), lambda s, t: s + leaf(t["tree"]))
        return rows.withColumn(out, total).select(*[c for c in df.columns if c != out], out)
