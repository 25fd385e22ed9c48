"""Sorts, top-k, unions, reshaping (K), bins and scalar functions (B), chart data (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.registry import PAIRS_CTE, query, r, rnd, rounded, rs, sql_normal_quantile
from truegauge.functions import scalar
from truegauge.operators import binning, charts, shaping, splits


@query("K1_sort_by_abs", f"WITH {PAIRS_CTE} SELECT o_orderkey, abs(delta) AS abs_residual, row_number() OVER (ORDER BY abs(delta) DESC, o_orderkey) - 1 AS position FROM pairs")
def sort_by_abs(t):
    from truegauge.operators.ordered import with_ordinal

    p = t.pairs.select("o_orderkey", F.abs("delta").alias("abs_residual")).withColumn("_d", -F.col("abs_residual"))
    placed = with_ordinal(p, ["_d", "o_orderkey"], name="position").drop("_d")
    return shaping.sort_by_size(placed, "abs_residual", "o_orderkey")


TRIALS = f"""WITH {PAIRS_CTE}, trials AS (SELECT grp, {rs(4, mae='avg(abs(delta))', gap='abs(avg(CASE WHEN delta > 0 THEN delta END) + avg(CASE WHEN delta < 0 THEN delta END))')},
  avg(delta) > 0 AS improved FROM pairs GROUP BY 1)"""


def trials(t):
    return t.pairs.groupBy("grp").agg(
        rnd(F.avg(F.abs("delta")), 4).alias("mae"),
        rnd(F.abs(F.avg(F.when(F.col("delta") > 0, F.col("delta"))) + F.avg(F.when(F.col("delta") < 0, F.col("delta")))), 4).alias("gap"),
        (F.avg("delta") > 0).alias("improved"),
    )


@query("K2_multi_key_sort", TRIALS + " SELECT * FROM trials ORDER BY improved DESC, mae, gap")
def multi_key_sort(t):
    return trials(t).orderBy(F.desc("improved"), "mae", "gap")


@query(
    "K3_custom_order",
    "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1",
)
def custom_order(t):
    place = shaping.custom_order(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT", "5-LOW"])
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).orderBy("place", "n")


@query("K4_smallest_share", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT (SELECT greatest(floor(count(*) * 0.05::DOUBLE)::BIGINT, 5) FROM orders)")
def smallest_share(t):
    return shaping.smallest_share(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 0.05, 5)


@query(
    "K5_union_tagged",
    "SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem",
)
def union_tagged(t):
    both = shaping.union_tagged({"orders": t.orders.select("o_orderkey"), "lines": t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))}, "source")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("K6_melt", TRIALS + " SELECT grp, metric, value FROM (UNPIVOT (SELECT grp, mae, gap FROM trials) ON mae, gap INTO NAME metric VALUE value)")
def melt(t):
    return shaping.melt(trials(t).select("grp", "mae", "gap"), ["grp"], ["mae", "gap"])


@query(
    "K7_pivot",
    "SELECT l_returnflag, " + r("avg(l_quantity) FILTER (l_linestatus = 'F')") + ' AS "F", ' + r("avg(l_quantity) FILTER (l_linestatus = 'O')") + ' AS "O" FROM lineitem GROUP BY 1',
)
def pivot(t):
    return rounded(shaping.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"]))


@query(
    "K8_transpose",
    f"""WITH m AS (SELECT o_orderstatus AS s, {rs(4, mean='avg(o_totalprice)', top='max(o_totalprice)')} FROM orders GROUP BY 1),
      u AS (UNPIVOT m ON mean, top INTO NAME field VALUE v)
      SELECT field, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM u GROUP BY 1""",
)
def transpose(t):
    m = t.orders.groupBy("o_orderstatus").agg(rnd(F.avg("o_totalprice"), 4).alias("mean"), rnd(F.max("o_totalprice"), 4).alias("top"))
    return shaping.transpose(m, "o_orderstatus", ["F", "O", "P"])


@query(
    "K9_equal_frequency_labels",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 1/3.0::DOUBLE) AS a, quantile_cont(o_totalprice, 2/3.0::DOUBLE) AS b FROM orders)
      SELECT CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'mid' ELSE 'high' END AS label, count(*) AS n FROM orders, q GROUP BY 1""",
)
def equal_frequency_labels(t):
    out = binning.quantile_bins(t.orders.select("o_totalprice"), "o_totalprice", 3, out="label", labels=["low", "mid", "high"])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("K10_common_keys", "SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def common_keys(t):
    other = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return shaping.common_keys(t.orders.select("o_orderkey"), other, "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("K11_distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("K12_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


EDGES = ", ".join(f"quantile_cont(delta, {i}/8.0::DOUBLE) AS e{i}" for i in range(9))
BIN8 = "greatest(1, " + " + ".join(f"(CASE WHEN e{i} < delta THEN 1 ELSE 0 END)" for i in range(9)) + ")"
BINNED = f"WITH {PAIRS_CTE}, e AS (SELECT grp, {EDGES} FROM pairs GROUP BY 1), b AS (SELECT pairs.*, {BIN8}::INTEGER AS bin FROM pairs JOIN e USING (grp))"


@query("B1_quantile_bins", BINNED + " SELECT o_orderkey, bin FROM b")
def quantile_bins(t):
    return binning.quantile_bins(t.pairs.select("o_orderkey", "grp", "delta"), "delta", 8, ["grp"]).select("o_orderkey", "bin")


@query(
    "B1_quantile_bins_tied",
    """WITH e AS (SELECT """ + ", ".join(f"quantile_cont(l_discount, {i}/20.0::DOUBLE) AS e{i}" for i in range(21)) + """ FROM lineitem),
      d AS (SELECT DISTINCT unnest([""" + ", ".join(f"e{i}" for i in range(21)) + """]) AS edge FROM e),
      v AS (SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1),
      b AS (SELECT l_discount, any_value(n) AS n, greatest(1, count(edge))::INTEGER AS bin FROM v LEFT JOIN d ON edge < l_discount GROUP BY 1)
      SELECT bin, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
)
def quantile_bins_tied(t):
    return binning.quantile_bins(t.lineitem.select("l_discount"), "l_discount", 20).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B2_equal_width_bins",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
      SELECT greatest(1, least(8, ceil((o_totalprice - lo) / ((hi - lo) / 8.0::DOUBLE))))::INTEGER AS bin, count(*) AS n FROM orders, s GROUP BY 1""",
)
def equal_width_bins(t):
    return binning.equal_width_bins(t.orders.select("o_totalprice"), "o_totalprice", 8).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


HIST = f"""WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30.0::DOUBLE AS w FROM orders),
  c AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / w), 29)::INTEGER AS bin, count(*) AS count, any_value(lo) AS lo, any_value(w) AS w FROM orders, s GROUP BY 1, 2)
  SELECT o_orderstatus, bin, {r('lo + bin * w', 4)} AS left, count, {r('count / (sum(count) OVER (PARTITION BY o_orderstatus) * w)', 10)} AS density FROM c"""


@query("B3_histogram", HIST.replace(" AS left,", ' AS "left",'))
def histogram(t):
    return rounded(binning.histogram(t.orders.select("o_orderstatus", "o_totalprice"), "o_totalprice", 30, ["o_orderstatus"]), 10, left=4)


@query("B4_clean_text", "SELECT doc_id, md5(trim(replace(replace(text, chr(13), ''), chr(10), ''), ' ')) AS cleaned FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", F.md5(scalar.clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query("B5_safe_name", "SELECT p_partkey, left(translate(p_name || ' [' || p_brand || '] (a/b)', '/\\ []()', '___'), 60) AS safe FROM part")
def safe_name(t):
    return t.part.select("p_partkey", scalar.safe_name(F.concat(F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("] (a/b)"))).alias("safe"))


@query("B6_elapsed_days", f"SELECT event_id, {r('(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000.0', 5)} AS days FROM events")
def elapsed_days(t):
    from truegauge.operators.lookup import attach

    e = attach(t.events.select("event_id", "ts"), t.events.agg(F.min("ts").alias("t0")))
    return rounded(e.select("event_id", scalar.elapsed_days(F.col("ts"), F.col("t0")).alias("days")), 5)


@query(
    "B7_effect_label",
    "SELECT l_linenumber, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS label FROM (SELECT l_linenumber, avg(l_discount) * l_linenumber * 2 AS d FROM lineitem GROUP BY 1)",
)
def effect_label(t):
    d = t.lineitem.groupBy("l_linenumber").agg((F.avg("l_discount") * F.col("l_linenumber") * 2).alias("d"))
    return d.select("l_linenumber", scalar.effect_label(F.col("d")).alias("label"))


@query(
    "B8_interpolation",
    f"""WITH g AS (SELECT p_retailprice AS x0, max(p_size)::DOUBLE AS y0 FROM part GROUP BY 1),
      s AS (SELECT x0, y0, lead(x0) OVER (ORDER BY x0) AS x1, lead(y0) OVER (ORDER BY x0) AS y1 FROM g)
      SELECT c_custkey, {r('CASE WHEN x0 IS NULL THEN (SELECT arg_min(y0, x0) FROM g) WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (c_acctbal - x0) / (x1 - x0) END')} AS y
      FROM customer ASOF LEFT JOIN s ON c_acctbal >= x0""",
)
def interpolation(t):
    grid = t.part.groupBy("p_retailprice").agg(F.max("p_size").alias("p_size"))
    out = binning.interpolate(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", grid, "p_retailprice", "p_size", "y")
    return rounded(out.select("c_custkey", "y"))


@query("B9_rounding", f"WITH {PAIRS_CTE} SELECT o_orderkey, {r('delta / 7', 7)} AS d4, {r('disc * 10 / 7', 7)} AS d2 FROM pairs")
def rounding(t):
    return t.pairs.select("o_orderkey", rnd(F.col("delta") / 7, 7).alias("d4"), rnd(F.col("disc") * 10 / 7, 7).alias("d2"))


# --- chart data -------------------------------------------------------------------------------


@query(
    "G1_histogram_by_role",
    f"""WITH {PAIRS_CTE}, o AS (SELECT delta, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= count(*) OVER () - ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM pairs),
      s AS (SELECT min(delta) AS lo, (max(delta) - min(delta)) / 20.0::DOUBLE AS w FROM o)
      SELECT role, least(floor((delta - lo) / w), 19)::INTEGER AS bin, count(*) AS count FROM o, s GROUP BY 1, 2""",
)
def histogram_by_role(t):
    split = splits.ordered_holdout(t.pairs.select("o_orderdate", "o_orderkey", "delta"), ["o_orderdate", "o_orderkey"], 0.2)
    return binning.histogram(split, "delta", 20, ["role"]).select("role", "bin", "count")


@query(
    "G2_normal_quantile_pairs",
    f"""WITH {PAIRS_CTE}, o AS (SELECT grp, o_orderkey, delta, row_number() OVER (PARTITION BY grp ORDER BY delta, o_orderkey)::DOUBLE AS i, count(*) OVER (PARTITION BY grp)::DOUBLE AS n FROM pairs),
      p AS (SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1 / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o)
      SELECT grp, o_orderkey, {r('delta')} AS ordered_value, {r(sql_normal_quantile('p'))} AS theoretical FROM p""",
)
def normal_quantile_pairs(t):
    return rounded(charts.normal_quantile_pairs(t.pairs.select("grp", "o_orderkey", "delta"), "delta", ["o_orderkey"], ["grp"]))


BOX = """q AS (SELECT o_orderpriority AS category, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)"""


@query(
    "G3_box_statistics",
    f"""WITH {BOX} SELECT category, {rs(4, q1='any_value(q1)', median='any_value(median)', q3='any_value(q3)',
      low='min(CASE WHEN o_totalprice >= q1 - 1.5::DOUBLE * (q3 - q1) THEN o_totalprice END)', high='max(CASE WHEN o_totalprice <= q3 + 1.5::DOUBLE * (q3 - q1) THEN o_totalprice END)')},
      count(*) FILTER (o_totalprice < q1 - 1.5::DOUBLE * (q3 - q1) OR o_totalprice > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
      FROM orders JOIN q ON o_orderpriority = category GROUP BY 1""",
)
def box_statistics(t):
    out = charts.box_statistics(t.orders, "o_totalprice", "o_orderpriority")
    return rounded(out.withColumnRenamed("o_orderpriority", "category"), 4)


@query("G4_scatter_sample")
def scatter_sample(t):
    return charts.scatter_sample(t.pairs.select("o_orderkey", "online", "delta"), "o_orderkey", 8000, 42)


@query(
    "G5_ordered_series",
    f"WITH {PAIRS_CTE} SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey, online, truth FROM pairs",
)
def ordered_series(t):
    return shaping.ordered_series(t.pairs, ["o_orderdate", "o_orderkey"], ["o_orderkey", "online", "truth"])
