"""Distribution profiles and scoped aggregates (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.registry import PAIRS_CTE, query, r, rounded, rs
from truegauge.operators import aggregates, binning
from truegauge.catalog.shaping import BINNED

PROFILE = ", ".join(
    [
        "count(delta) AS count",
        rs(4, mean="avg(delta)", std="stddev_samp(delta)", min="min(delta)", max="max(delta)"),
        rs(6, skew="skewness(delta)", kurtosis="kurtosis(delta)"),
        rs(6, pos_ratio="count(*) FILTER (delta > 0) / count(delta)", neg_ratio="count(*) FILTER (delta < 0) / count(delta)"),
        rs(4, q25="quantile_cont(delta, 0.25)", median="quantile_cont(delta, 0.5)", q75="quantile_cont(delta, 0.75)"),
    ]
)
FOUR = {c: 4 for c in ("mean", "std", "min", "max", "q25", "median", "q75")}


@query("A3_series_profile", f"WITH {PAIRS_CTE} SELECT {PROFILE} FROM pairs")
def series_profile(t):
    return rounded(aggregates.profile(t.pairs, "delta"), 6, **FOUR)


@query(
    "A4_profile_by_group",
    f"WITH {PAIRS_CTE} SELECT grp, {PROFILE} FROM pairs WHERE grp IN (SELECT grp FROM pairs GROUP BY 1 ORDER BY count(*) DESC, grp LIMIT 8) GROUP BY 1 HAVING count(*) >= 30",
)
def profile_by_group(t):
    return rounded(aggregates.profile_groups(t.pairs, "delta", "grp", 8), 6, **FOUR)


@query(
    "A4_profile_whitelist",
    f"WITH {PAIRS_CTE} SELECT grp, {PROFILE} FROM pairs WHERE grp IN ('F_1-URGENT', 'P_5-LOW') GROUP BY 1 HAVING count(*) >= 30",
)
def profile_whitelist(t):
    return rounded(aggregates.profile_groups(t.pairs, "delta", "grp", 8, only=["F_1-URGENT", "P_5-LOW"]), 6, **FOUR)


@query(
    "A5_sign_balance",
    f"""WITH {PAIRS_CTE} SELECT grp, count(*) AS total, count(*) FILTER (delta > 0) AS pos, count(*) FILTER (delta < 0) AS neg,
      {r('100.0 * count(*) FILTER (delta > 0) / count(*)')} AS pos_pct, {r('100.0 * count(*) FILTER (delta < 0) / count(*)')} AS neg_pct, {r('avg(delta)', 4)} AS mean FROM pairs GROUP BY 1""",
)
def sign_balance(t):
    return rounded(aggregates.sign_balance(t.pairs, "delta", ["grp"]), 6, mean=4)


def _dir(mask):
    return f"""count(*) FILTER ({mask} > 0) AS pos_count, count(*) FILTER ({mask} < 0) AS neg_count,
      {r(f'avg(abs(res)) FILTER ({mask} > 0)', 4)} AS pos_mae, {r(f'avg(abs(res)) FILTER ({mask} < 0)', 4)} AS neg_mae"""


CORRECTED = PAIRS_CTE + ", m AS (SELECT avg(delta) AS m FROM pairs), c AS (SELECT pairs.*, round(delta - m, 4) AS res FROM pairs, m)"


def corrected(t):
    from truegauge.operators.lookup import attach

    p = t.pairs
    return attach(p, p.agg(F.avg("delta").alias("m"))).withColumn("res", F.round(F.col("delta") - F.col("m"), 4)).drop("m")


@query("A6_directional_mae_model_sign", f"WITH {CORRECTED} SELECT grp, {_dir('res')} FROM c GROUP BY 1")
def directional_model(t):
    return rounded(aggregates.directional_mae(corrected(t), "res", "res", ["grp"]), 4)


@query("A7_directional_mae_raw_sign", f"WITH {CORRECTED} SELECT grp, {_dir('delta')} FROM c GROUP BY 1")
def directional_raw(t):
    return rounded(aggregates.directional_mae(corrected(t), "res", "delta", ["grp"]), 4)


@query(
    "A8_A9_bin_summary",
    BINNED
    + f""" SELECT grp, bin, count(truth) AS count, {rs(4, mean='avg(truth)', std='stddev_samp(truth)', sem='stddev_samp(truth) / sqrt(count(truth))',
      low='avg(truth) - 1.96::DOUBLE * stddev_samp(truth) / sqrt(count(truth))', high='avg(truth) + 1.96::DOUBLE * stddev_samp(truth) / sqrt(count(truth))', centre='avg(delta)')} FROM b GROUP BY 1, 2""",
)
def bin_summary(t):
    binned = binning.quantile_bins(t.pairs.select("grp", "delta", "truth"), "delta", 8, ["grp"])
    return rounded(binning.bin_summary(binned, "truth", "delta", ["grp", "bin"]), 4)


@query("A10_group_ranking", f"WITH {PAIRS_CTE} SELECT grp, count(*) AS samples FROM pairs GROUP BY 1 ORDER BY samples DESC, grp LIMIT 10")
def group_ranking(t):
    return aggregates.largest_groups(t.pairs, ["grp"], 10)


@query("A11_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A12_median_ordered_categories",
    f"""WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 15),
      m AS (SELECT p_brand, median(p_retailprice) AS median FROM part WHERE p_brand IN (SELECT p_brand FROM top) GROUP BY 1)
      SELECT p_brand, {r('median')} AS median, row_number() OVER (ORDER BY median, p_brand)::INTEGER AS place FROM m""",
)
def median_ordered_categories(t):
    return rounded(aggregates.median_ordered(t.part, "p_brand", "p_retailprice"))


@query(
    "A14_best_per_tag",
    "SELECT * FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) "
    .replace("SELECT * FROM (SELECT *", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *"),
)
def best_per_tag(t):
    return aggregates.best_per_tag(t.orders, "o_custkey", [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


SCOPED = ", ".join(
    [
        "count(delta) AS n",
        rs(4, mean="avg(delta)", std="stddev_samp(delta)", min="min(delta)", max="max(delta)", median="quantile_cont(delta, 0.5)"),
        rs(6, skew="skewness(delta)", pos_ratio="count(*) FILTER (delta > 0) / count(delta)", neg_ratio="count(*) FILTER (delta < 0) / count(delta)"),
    ]
)


@query(
    "A15_scoped_summary",
    f"""WITH {PAIRS_CTE} SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'overall' ELSE 'by_group' END AS scope, o_orderstatus,
      o_orderpriority, {SCOPED} FROM pairs GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""",
)
def scoped_summary(t):
    p = t.pairs.select("o_orderstatus", "o_orderpriority", "delta")
    return rounded(aggregates.scoped_summary(p, "delta", "o_orderstatus", "o_orderpriority"), 6, **FOUR)
