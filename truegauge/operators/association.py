"""Association of features with delta: linear, rank, information and distance measures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegauge.functions.exact import RANK_ROWS, rank_sum_exact
from truegauge.functions.tails import normal_tail, t_tail
from truegauge.operators.binning import bin_index
from truegauge.operators.ordered import running_totals, with_ordinal
from truegauge.operators.lookup import attach
from truegauge.operators.quantiles import average_ranks, exact_quantiles, value_positions
from truegauge.session import materialise


def complete(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Rows with every column present, as double."""
    kept = [F.col(k) for k in keep if k not in columns]
    return df.select(*kept, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any", subset=list(columns))


def pearson_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long ``(by..., a, b, r)`` of the full symmetric matrix from one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    rows = complete(df, columns, *by)
    wide = rows.groupBy(*by).agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [(a, a, F.lit(1.0)) for a in columns]
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"_r{i}")), (b, a, F.col(f"_r{i}"))]
    packed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("r")) for a, b, v in cells])
    return wide.select(*by, F.inline(packed))


def against(matrix: DataFrame, target: str, value: str = "r") -> DataFrame:
    """One column of a matrix, strongest first."""
    picked = matrix.where((F.col("b") == target) & (F.col("a") != target)).withColumnRenamed("a", "feature").drop("b")
    return picked.orderBy(F.abs(F.col(value)).desc(), "feature")


def spearman_matrix(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Pearson matrix of average-tie ranks. All features are ranked in one long pass; ``key`` is unique."""
    rows = complete(df, columns, key)
    long = rows.unpivot([key], list(columns), "feature", "x")
    ranks = average_ranks(long, "x", ["feature"]).select("feature", "x", "rank")
    wide = long.join(ranks, ["feature", "x"]).groupBy(key).pivot("feature", list(columns)).agg(F.max("rank"))
    return pearson_matrix(wide, columns)


def pairwise_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    wide = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


# --- mutual information ------------------------------------------------------------------------


def binned_wide(df: DataFrame, columns: Sequence[str], q: int) -> DataFrame:
    """Replace each column by its equal-frequency bin. Edges of all columns arrive as one row."""
    names = [f"e{i}" for i in range(q + 1)]
    long = df.unpivot([], list(columns), "feature", "x")
    edges = exact_quantiles(long, "x", {n: i / q for i, n in enumerate(names)}, ["feature"])
    one = edges.groupBy().agg(
        *[F.max(F.when(F.col("feature") == c, F.struct(*names))).alias(f"_edges_{i}") for i, c in enumerate(columns)]
    )
    placed = attach(df, one)
    return placed.select(
        *[bin_index(F.col(c), [F.col(f"_edges_{i}.{n}") for n in names]).alias(c) for i, c in enumerate(columns)]
    )


def mutual_information(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = 16) -> DataFrame:
    """Plug-in estimate in nats per pair. Only bin counts are shuffled."""
    columns = list(dict.fromkeys(itertools.chain.from_iterable(pairs)))
    binned = binned_wide(complete(df, columns), columns, bins)
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    joint = materialise(
        binned.select(F.inline(cells)).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n")), "joint"
    )
    px = joint.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("a", "b").agg(F.sum("n").alias("nn"))
    all_counts = joint.join(px, ["a", "b", "x"]).join(py, ["a", "b", "y"]).join(total, ["a", "b"])
    term = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    return all_counts.groupBy("a", "b").agg(F.sum(term).alias("mi"))


def mutual_information_matrix(df: DataFrame, columns: Sequence[str], bins: int = 16) -> DataFrame:
    """Symmetric long matrix with a zero diagonal."""
    upper = mutual_information(df, list(itertools.combinations(columns, 2)), bins)
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi")
    diagonal = upper.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("mi"))
    return upper.unionByName(lower).unionByName(diagonal)


# --- distance correlation ----------------------------------------------------------------------
#
# Both double sums of distances reduce to sums over sorted order, so no pair of rows is ever formed:
# row sums need prefix sums, and the cross term needs, for each row, sums over the rows that precede
# it in x *and* in y. Both positions are cut into blocks of about the root of the rows. Rows of one
# x-block meet in the task of that block, rows of one y-block in the task of that one, where the bits of
# the x-position split the question into levels: two rows meet at exactly one level, in one node, in
# different halves. Rows that share neither block meet as sums of cells (x-block, y-block). So every row
# moves twice, whatever the number of levels.


def _dominated_in_block(first: int, last: int):
    """Cross term of the rows of one block that meet at the levels from ``first`` up to ``last``, exclusive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ry", kind="stable")
        rx, x, y = pdf["rx"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy()
        terms = np.column_stack([np.ones_like(x), x, y, x * y])
        total = 0.0
        for level in range(first, last):
            order = np.argsort(rx >> (level + 1), kind="stable")
            node, upper = (rx >> (level + 1))[order], ((rx >> level) & 1)[order] == 1
            run_sum = np.cumsum(np.where(upper[:, None], 0.0, terms[order]), axis=0)
            start = np.searchsorted(node, node, side="left")
            base = np.where(start[:, None] > 0, run_sum[np.maximum(start - 1, 0)], 0.0)
            c, sx, sy, sxy = (run_sum - base)[upper].T
            xu, yu = x[order][upper], y[order][upper]
            total += float(np.sum(xu * yu * c - xu * sy - yu * sx + sxy))
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "dom": [total]})

    return run


def _dominated_over_blocks(paired: DataFrame, block: int, blocks: int) -> DataFrame:
    """Cross term of the rows that share neither the x-block nor the y-block, from the sums of the cells: at most ``blocks`` squared of them a pair, not more
    than a fraction of the rows."""
    x, y = F.col("x"), F.col("y")
    cells = paired.groupBy("a", "b", F.shiftright("rx", block).alias("bx"), F.shiftright("ry", block).alias("by")).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy")
    )
    # Empty cells carry the sums of the cells before them.
    grid = cells.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bx"))
    grid = grid.withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({c: F.col(c).cast("long") for c in ("bx", "by")})
    names = ("c", "sx", "sy", "sxy")
    whole = grid.join(cells, ["a", "b", "bx", "by"], "left").fillna(0.0, list(names))
    along = Window.partitionBy("a", "b", "bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("a", "b", "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({f"_r{n}": F.coalesce(F.sum(n).over(along), F.lit(0.0)) for n in names})
    whole = whole.withColumns({f"_p{n}": F.coalesce(F.sum(f"_r{n}").over(across), F.lit(0.0)) for n in names})
    term = F.col("sxy") * F.col("_pc") - F.col("sx") * F.col("_psy") - F.col("sy") * F.col("_psx") + F.col("c") * F.col("_psxy")
    return whole.groupBy("a", "b").agg(F.sum(term).alias("dom"))


def distance_correlation(
    df: DataFrame, key: str, pairs: Sequence[tuple[str, str]], block_levels: int = 16, partitions: int | None = None
) -> DataFrame:
    """Exact distance correlation per pair in O(n log n) work; 0 for a constant column. ``key`` is unique.

    Blocks hold ``2**block_levels`` rows, more only where their number squared would come near the rows.
    """
    columns = list(dict.fromkeys(itertools.chain.from_iterable(pairs)))
    rows = materialise(complete(df, columns, key), "complete")
    means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    centred = attach(rows, means).select(key, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])
    long = centred.unpivot([key], columns, "feature", "x")
    placed = running_totals(
        long, ["feature"], ["x", key], {"r": F.lit(1).cast("long"), "s": F.col("x")}, partitions, overall=True
    )
    r, n, x, s = F.col("r"), F.col("r_all"), F.col("x"), F.col("s")
    row_sum = x * (r - 1) - (s - x) + (F.col("s_all") - s) - x * (n - r)
    per_row = placed.select(key, "feature", F.struct(x.alias("x"), (r - 1).alias("r"), row_sum.alias("d"), n.alias("n")).alias("v"))
    wide = per_row.groupBy(key).pivot("feature", columns).agg(F.first("v"))
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`.x").alias("x"), F.col(f"`{b}`.x").alias("y"),
                F.col(f"`{a}`.r").alias("rx"), F.col(f"`{b}`.r").alias("ry"), F.col(f"`{a}`.d").alias("dx"),
                F.col(f"`{b}`.d").alias("dy"), F.col(f"`{a}`.n").alias("n"),
            )
            for a, b in pairs
        ]
    )
    paired = materialise(wide.select(F.inline(cells)), "paired")

    sums = paired.groupBy("a", "b").agg(
        F.max("n").cast("double").alias("n"),
        *[F.sum(e).alias(k) for k, e in {
            "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"),
            "sxy": F.col("x") * F.col("y"), "dx": F.col("dx"), "dy": F.col("dy"), "dxdy": F.col("dx") * F.col("dy"),
            "dxx": F.col("dx") * F.col("dx"), "dyy": F.col("dy") * F.col("dy"),
        }.items()],
    )

    # The number of levels follows from n, read once from the one-row count.
    levels = math.ceil(math.log2(max(rows.count(), 2)))
    block = max(block_levels, math.ceil(levels / 2) + 2)
    blocks = 1 << max(0, levels - block)

    def within(position: str, first: int, last: int) -> DataFrame:
        placed = paired.select("a", "b", "x", "y", "rx", "ry", F.shiftright(position, block).alias("_blk"))
        return placed.groupBy("a", "b", "_blk").applyInPandas(_dominated_in_block(first, last), "a string, b string, dom double")

    dominated = within("rx", 0, min(block, levels))
    if blocks > 1:
        dominated = dominated.unionByName(within("ry", block, levels)).unionByName(_dominated_over_blocks(paired, block, blocks))
    dom = dominated.groupBy("a", "b").agg(F.sum("dom").alias("dom"))

    m = F.col("n")
    cross = 2 * (2 * F.col("dom") - (m * F.col("sxy") - F.col("sx") * F.col("sy")))

    def cov(products, d1d2, d1, d2):
        return products / (m * m) - 2 * d1d2 / (m * m * m) + d1 * d2 / (m * m * m * m)

    vxx = cov(2 * m * F.col("sxx") - 2 * F.col("sx") * F.col("sx"), F.col("dxx"), F.col("dx"), F.col("dx"))
    vyy = cov(2 * m * F.col("syy") - 2 * F.col("sy") * F.col("sy"), F.col("dyy"), F.col("dy"), F.col("dy"))
    vxy = cov(cross, F.col("dxdy"), F.col("dx"), F.col("dy"))
    constant = (F.col("sxx") / m < 1e-20) | (F.col("syy") / m < 1e-20)
    dcor = F.sqrt(F.greatest(vxy, F.lit(0.0)) / F.sqrt(vxx * vyy))
    return sums.join(dom, ["a", "b"]).select("a", "b", F.when(constant, F.lit(0.0)).otherwise(dcor).alias("dcor"))


def distance_correlation_matrix(df: DataFrame, key: str, columns: Sequence[str], **kw) -> DataFrame:
    """Upper triangle mirrored, ones on the diagonal."""
    upper = distance_correlation(df, key, list(itertools.combinations(columns, 2)), **kw)
    upper = materialise(upper, "dcor")
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "dcor")
    diagonal = upper.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("dcor"))
    return upper.unionByName(lower).unionByName(diagonal)


# --- effect size, trend, capability --------------------------------------------------------------


def mann_whitney(df: DataFrame, value: str, in_first: str, by: Sequence[str] = ()) -> DataFrame:
    """U of the rows where the flag is true against the rest, and Cliff's delta ``2U / (n m) - 1``."""
    flag = F.coalesce(F.col(in_first), F.lit(False)).cast("long")
    at = value_positions(df.withColumn("_f", flag), value, by, {"first": F.col("_f")})
    rank = F.col("upto") - (F.col("cnt") - 1) / 2
    sums = at.groupBy(*by).agg(
        F.max("cum_first_all").alias("n_first"),
        F.max(F.col("upto_all") - F.col("cum_first_all")).alias("n_rest"),
        F.sum(rank * F.col("w_first")).alias("_r"),
    )
    u = F.col("_r") - F.col("n_first") * (F.col("n_first") + 1) / 2
    return sums.select(
        *by, "n_first", "n_rest", u.alias("u"), (F.try_divide(2 * u, F.col("n_first") * F.col("n_rest")) - 1).alias("cliffs_delta")
    )


def rank_sum_test(df: DataFrame, value: str, in_first: str, by: Sequence[str] = ()) -> DataFrame:
    """U of the flagged rows against the rest, its deviate ``z`` and two-sided ``p_value``.

    Up to ``RANK_ROWS`` rows of a group (``exact``) the p-value is twice the smaller tail among all choices of the first sample, ties included;
    beyond, the normal one with variance corrected for ties and half a step of continuity. NULL values are left out; NULL flags count as
    false. With one side empty, or all values equal, ``z`` is NULL; with one side empty ``p_value`` is, too.
    """
    flag = F.coalesce(F.col(in_first), F.lit(False)).cast("long")
    at = value_positions(df.withColumn("_f", flag), value, by, {"first": F.col("_f")})
    rank, t = F.col("upto") - (F.col("cnt") - 1) / 2, F.col("cnt").cast("double")
    few = F.when(F.col("upto_all") <= RANK_ROWS, F.struct("upto", "cnt", "w_first"))
    sums = at.groupBy(*by).agg(
        F.max("cum_first_all").alias("n_first"),
        F.max(F.col("upto_all") - F.col("cum_first_all")).alias("n_rest"),
        F.sum(rank * F.col("w_first")).alias("_r"),
        F.sum(t * t * t - t).alias("_ties"),
        F.sort_array(F.collect_list(few)).alias("_few"),
    )
    a, b = F.col("n_first").cast("double"), F.col("n_rest").cast("double")
    u, n = F.col("_r") - a * (a + 1) / 2, a + b
    spread = F.sqrt(a * b / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0)), F.nullif(spread, F.lit(0.0)))
    out = sums.withColumns({"u": u, "z": z, "exact": n <= RANK_ROWS})
    out = out.withColumns({"_law": rank_sum_exact(F.col("_few")["cnt"], F.col("_few")["w_first"]), "_normal": F.least(2 * normal_tail(F.coalesce("z", F.lit(0.0))), F.lit(1.0))})
    p = F.when((F.col("n_first") > 0) & (F.col("n_rest") > 0), F.when(F.col("exact"), F.col("_law")).otherwise(F.col("_normal")))
    return out.select(*by, "n_first", "n_rest", "u", "z", "exact", p.alias("p_value"))


def time_trend(df: DataFrame, delta: str, days: str, by: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """Least-squares slope per day with its two-sided p-value."""
    pair = df.where(F.col(delta).isNotNull() & F.col(days).isNotNull())
    fit = pair.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(delta, days).alias("slope"), F.corr(delta, days).alias("r")
    )
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return (
        fit.where(F.col("n") >= min_rows)
        .withColumn("t", t)
        .withColumn("p_value", t_tail(F.col("t"), (F.col("n") - 2).cast("double")))
        .withColumn("significant", F.col("p_value") < 0.05)
    )


def capability(df: DataFrame, value: str, lower: float | None = None, upper: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cpk and Ppk against specification limits; without limits mean ± 3 sd stands in (always 1)."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    lsl = F.lit(lower) if lower is not None else mean - 3 * sd
    usl = F.lit(upper) if upper is not None else mean + 3 * sd
    index = F.when(sd > 0, F.least((usl - mean) / (3 * sd), (mean - lsl) / (3 * sd)))
    return df.groupBy(*by).agg(index.alias("cpk"), index.alias("ppk"))


# --- locally weighted regression -----------------------------------------------------------------


def _partial_fits(columns: list[str], grid: list[tuple[float, float]]):
    """Per batch: weighted sums of a local line at every grid point; rows never leave the batch."""
    at = np.array([g[0] for g in grid])
    reach = np.array([max(g[1], 1e-300) for g in grid])

    def run(batches):
        acc = np.zeros((len(grid), 6))
        for pdf in batches:
            x, y, w0 = (pdf[c].to_numpy(dtype="float64") for c in columns)
            for lo in range(0, len(x), 8192):
                dx = x[None, lo : lo + 8192] - at[:, None]
                u = np.abs(dx) / reach[:, None]
                t = 1 - u * u * u
                w = np.where(u < 1, t * t * t, 0.0) * w0[None, lo : lo + 8192]
                yy = y[None, lo : lo + 8192]
                acc[:, 1:] += np.stack([w.sum(1), (w * dx).sum(1), (w * dx * dx).sum(1), (w * yy).sum(1), (w * dx * yy).sum(1)], axis=1)
        acc[:, 0] = np.arange(len(grid))
        yield pd.DataFrame(acc, columns=["g", "w", "wx", "wxx", "wy", "wxy"])

    return run


def lowess(df: DataFrame, x: str, y: str, key: str, frac: float = 0.3, points: int = 101, robust: int = 3) -> DataFrame:
    """Curve ``(point, x, fitted)`` at ``points`` positions evenly spaced in the order of ``x``.

    The bandwidth of each position is the exact distance to its k-th nearest row. Tasks emit one
    partial sum per position, so the shuffle carries ``points`` rows per task.
    """
    rows = materialise(
        with_ordinal(df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(), ["x", key], name="i"), "lowess"
    )
    n = rows.count()
    k = max(2, min(n, int(frac * n + 1e-10)))
    spots = [j * (n - 1) // (points - 1) for j in range(points)]
    centres = {r["i"]: r["x"] for r in rows.where(F.col("i").isin(spots)).select("i", "x").collect()}
    at = [centres[s] for s in spots]
    # Windows of k consecutive rows: an equi-join of each row with the one k-1 places on.
    ends = rows.select((F.col("i") - (k - 1)).alias("i"), F.col("x").alias("x_end"))
    windows = rows.select("i", "x").join(ends, "i")

    centre_values = np.array(at)

    def nearest(batches):
        best = np.full(len(centre_values), np.inf)
        for pdf in batches:
            a, b = pdf["x"].to_numpy(), pdf["x_end"].to_numpy()
            for lo in range(0, len(a), 8192):
                far = np.maximum(centre_values[:, None] - a[None, lo : lo + 8192], b[None, lo : lo + 8192] - centre_values[:, None])
                best = np.minimum(best, far.min(axis=1))
        yield pd.DataFrame({"g": np.arange(len(best)), "h": best})

    reach = {
        int(r["g"]): r["h"]
        for r in windows.select("x", "x_end").mapInPandas(nearest, "g long, h double").groupBy("g").agg(F.min("h").alias("h")).collect()
    }
    grid = [(a, reach[g]) for g, a in enumerate(at)]

    def fit(weighted: DataFrame) -> DataFrame:
        sums = (
            weighted.select("x", "y", "w")
            .mapInPandas(_partial_fits(["x", "y", "w"], grid), "g double, w double, wx double, wxx double, wy double, wxy double")
            .groupBy(F.col("g").cast("int").alias("point"))
            .agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx", "wy", "wxy")])
        )
        det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
        line = (F.col("wy") * F.col("wxx") - F.col("wx") * F.col("wxy")) / det
        flat = F.try_divide(F.col("wy"), F.col("w"))
        xs = F.element_at(F.array(*[F.lit(a) for a in at]), F.col("point") + 1)
        return sums.select(
            "point", xs.alias("x"), F.when(det > 1e-12 * F.col("w") * F.col("wxx"), line).otherwise(flat).alias("fitted")
        )

    def smoothed(curve: DataFrame) -> DataFrame:
        """``rows`` with ``_f``, the curve's value at their ``x``: the curve is a row per point, so it goes to every task."""
        knots = sorted((r["x"], r["fitted"]) for r in curve.groupBy("x").agg(F.avg("fitted").alias("fitted")).collect())
        gx, gy = (np.array([np.nan if k[i] is None else k[i] for k in knots], dtype=float) for i in (0, 1))

        @F.pandas_udf("double")
        def look_up(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype="float64")
            right = np.clip(np.searchsorted(gx, v, side="right"), 1, max(len(gx) - 1, 1))
            if len(gx) < 2:
                return pd.Series(np.full(len(v), gy[0]))
            x0, x1, y0, y1 = gx[right - 1], gx[right], gy[right - 1], gy[right]
            return pd.Series(np.where(v <= gx[0], gy[0], np.where(v >= gx[-1], gy[-1], y0 + (y1 - y0) * (v - x0) / (x1 - x0))))

        return rows.withColumn("_f", F.nanvl(look_up("x"), F.lit(None).cast("double")))

    curve = fit(rows.withColumn("w", F.lit(1.0)))
    for _ in range(robust):
        curve = materialise(curve, "curve")
        resid = materialise(smoothed(curve).withColumn("_r", F.abs(F.col("y") - F.col("_f"))), "resid")
        scale = exact_quantiles(resid, "_r", {"_med": 0.5})
        u = F.try_divide(F.col("_r"), 6 * F.nullif(F.col("_med"), F.lit(0.0)))
        weighted = attach(resid, scale).withColumn("w", F.when(u.isNull(), 1.0).when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0))
        curve = fit(weighted)
    return curve


def lowess_summary(curve: DataFrame) -> DataFrame:
    """Direction, curvature, point nearest zero and 5-95% change of a fitted curve (one row)."""
    curve = materialise(curve, "curve")
    last = curve.agg(F.max("point").alias("_last"), F.avg("x").alias("_mx"))
    c = attach(curve, last).withColumn("c", F.col("x") - F.col("_mx"))
    y = F.col("fitted")
    n, s = F.count(F.lit(1)).cast("double"), lambda e: F.sum(e)
    c1, c2 = F.col("c"), F.col("c") * F.col("c")
    agg = c.agg(
        F.regr_slope(y, F.col("x")).alias("slope"),
        (F.max(y) - F.min(y)).alias("_ry"),
        (F.max("x") - F.min("x")).alias("_rx"),
        F.min_by("x", F.abs(y)).alias("extreme_x"),
        F.min_by(y, F.abs(y)).alias("extreme_delta"),
        F.max(F.when(F.col("point") == F.round(F.col("_last") * 0.05), y)).alias("_y05"),
        F.max(F.when(F.col("point") == F.round(F.col("_last") * 0.95), y)).alias("_y95"),
        n.alias("_n"), s(c2).alias("_s2"), s(c2 * c1).alias("_s3"), s(c2 * c2).alias("_s4"),
        s(y).alias("_sy"), s(c1 * y).alias("_sxy"), s(c2 * y).alias("_sx2y"),
    )
    # Leading coefficient of the least-squares parabola on centred x (normal equations, sum of c is 0).
    n_, s2, s3, s4 = (F.col(k) for k in ("_n", "_s2", "_s3", "_s4"))
    num = n_ * (s2 * F.col("_sx2y") - s3 * F.col("_sxy")) - s2 * s2 * F.col("_sy")
    den = n_ * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    quad = F.try_divide(num, F.nullif(den, F.lit(0.0)))
    limit = 0.001 * F.col("_ry") / (F.col("_rx") + 1e-10)
    return agg.select(
        F.when(F.abs("slope") < limit, "flat").when(F.col("slope") > 0, "up").otherwise("down").alias("direction"),
        F.when(quad > 0, "U").when(quad < 0, "inverted U").otherwise("linear").alias("shape"),
        "slope",
        quad.alias("quadratic"),
        "extreme_x",
        "extreme_delta",
        F.abs(F.col("_y95") - F.col("_y05")).alias("delta_range"),
    )
