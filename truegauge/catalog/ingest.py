"""Scans, headers, renames, sinks and parameters (S), joins (J), strategy aggregates (A1, A2)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.catalog.registry import PAIRS_CTE, Tables, query, r, rnd, rounded, rs
from truegauge.functions import scalar
from truegauge.operators import merge
from truegauge.sources import readers, sinks
from truegauge.session import shared_dir


def scratch(t: Tables, label: str) -> str:
    return f"{shared_dir(t.spark)}/truegauge/{t.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query(
    "S1_union_scan",
    "SELECT l_returnflag, count(*) AS n, 1::BIGINT AS files, "
    + r("sum(l_extendedprice)", 2)
    + " AS price FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY 1",
)
def union_scan(t):
    twice = readers.union_scan(t.spark, [t.path("lineitem"), t.path("lineitem")], ["l_returnflag", "l_extendedprice"])
    return twice.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("files"), rnd(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    "S2_master_rows",
    """SELECT count(*) AS kept, count(l_comment) AS filled FROM (
      SELECT nullif(l_returnflag, 'R') AS l_comment, nullif(l_linestatus, 'F') AS s FROM lineitem)
      WHERE l_comment IS NOT NULL OR s IS NOT NULL""",
)
def master_rows(t):
    picked = t.lineitem.select(
        F.nullif("l_returnflag", F.lit("R")).alias("l_comment"), F.nullif("l_linestatus", F.lit("F")).alias("s")
    )
    return readers.master_rows(picked).agg(F.count(F.lit(1)).alias("kept"), F.count("l_comment").alias("filled"))


@query(
    "S3_lab_csv_gbk",
    "SELECT o_orderpriority AS grade, count(*) AS n, " + r("sum(o_totalprice)", 2) + " AS total, count(*) FILTER (o_orderkey % 7 = 0) AS labelled FROM orders GROUP BY 1",
)
def lab_csv(t):
    path = scratch(t, "lab-csv")
    # Plain headers and first rows; the text that tells the encodings apart comes late, and the folder mixes both encodings.
    label = F.when(F.col("o_orderkey") % 7 == 0, "镀层").otherwise("plain")
    lab = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("grade"), "o_totalprice", label.alias("label"))
    readers.allow_java_charsets(t.spark)
    for odd, code in enumerate(("utf-8", "gbk")):
        part = lab.where(F.col("o_orderkey") % 2 == odd).sortWithinPartitions(F.col("label") != "plain")
        part.write.mode("append").csv(path, header=True, encoding=code)
    schema = T.StructType.fromDDL("o_orderkey bigint, grade string, o_totalprice double, label string")
    back = readers.lab_csv(t.spark, path, schema, encoding="utf-8", fallback="gbk")
    return back.groupBy("grade").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("label") == "镀层").alias("labelled")
    )


@query("S4_offset_header", "SELECT CASE WHEN p_partkey % 50 = 0 THEN 'b' ELSE p_brand END AS p_brand, count(*) AS n, " + r("sum(p_retailprice)", 2) + " AS price FROM part GROUP BY 1")
def offset_header(t):
    """Files with a banner, then the names, then data in which some cells equal a name."""
    path = scratch(t, "offset-header")
    brand = F.when(F.col("p_partkey") % 50 == 0, "b").otherwise(F.col("p_brand"))
    data = t.part.select(F.pmod("p_partkey", F.lit(3)).alias("file"), F.lit(1).alias("place"), F.concat_ws(",", "p_partkey", brand, F.col("p_retailprice").cast("string")).alias("line"))
    top = data.select("file").distinct().select("file", F.lit(0).alias("place"), F.lit("Report of June,,\n a ,b,c ").alias("line"))
    rows = top.unionByName(data).repartition("file").sortWithinPartitions("file", "place")
    rows.select("file", "line").write.partitionBy("file").text(path)
    names = [" a ", "b", "c "]
    df = readers.offset_header_csv(t.spark, path, names, skip=1)
    return df.groupBy(F.col("b").alias("p_brand")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("c").cast("double")), 2).alias("price")
    )


@query("S5_rename_patch", "SELECT c_mktsegment AS segment, count(*) AS n, count(c_acctbal) AS balance FROM customer GROUP BY 1")
def rename_patch(t):
    df = readers.patch_names(t.customer, {"c_mktsegment": "segment", "c_acctbal": "balance", "not_there": "x"})
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("balance"))


@query(
    "S6_flatten_header",
    """WITH h AS (SELECT p_partkey AS col_idx, CASE WHEN p_type = 'ECONOMY' THEN p_type END AS h1,
        CASE WHEN p_size <= 10 THEN p_brand END AS h2, CASE WHEN p_size <= 25 THEN p_name END AS h3 FROM part),
      f AS (SELECT col_idx, last_value(h1 IGNORE NULLS) OVER w AS h1, last_value(h2 IGNORE NULLS) OVER w AS h2, h3
        FROM h WINDOW w AS (ORDER BY col_idx ROWS UNBOUNDED PRECEDING)),
      b AS (SELECT col_idx, concat_ws('_', h1, CASE WHEN h2 IS DISTINCT FROM h1 THEN h2 END,
        CASE WHEN h3 IS DISTINCT FROM h2 THEN h3 END) AS base FROM f),
      s AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY col_idx) - 1 AS seen FROM b)
      SELECT col_idx, CASE WHEN seen = 0 THEN base ELSE base || '_' || seen::VARCHAR END AS name FROM s""",
)
def flatten_header(t):
    header = t.part.select(
        F.col("p_partkey").alias("col_idx"),
        F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).alias("h1"),
        F.when(F.col("p_size") <= 10, F.col("p_brand")).alias("h2"),
        F.when(F.col("p_size") <= 25, F.col("p_name")).alias("h3"),
    )
    return readers.flatten_header(header)


@query(
    "S7_table_sink",
    "SELECT 'flags' AS sheet, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) UNION ALL SELECT 'orders', count(*) FROM orders",
)
def table_sink(t):
    paths = sinks.write_tables(
        {"flags": t.lineitem.select("l_returnflag", "l_linestatus").distinct(), "orders": t.orders}, scratch(t, "tables")
    )
    parts = [t.spark.read.parquet(p).agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query(
    "S8_run_log",
    f"""WITH {PAIRS_CTE}, m AS (SELECT grp, {rs(4, mae="avg(abs(delta))", bias="avg(delta)")}, count(*)::DOUBLE AS n FROM pairs GROUP BY 1)
      SELECT run_ts, grp, 'train' AS source, metric, value FROM
        (UNPIVOT m ON mae, bias, n INTO NAME metric VALUE value) CROSS JOIN (VALUES ('r1'), ('r2')) AS runs(run_ts)""",
)
def run_log(t):
    path = scratch(t, "runlog")
    m = t.pairs.groupBy("grp").agg(
        rnd(F.avg(F.abs("delta")), 4).alias("mae"), rnd(F.avg("delta"), 4).alias("bias"), F.count(F.lit(1)).alias("n")
    )
    for run in ("r1", "r2"):
        sinks.append_log(sinks.run_log(m, ["grp"], run, "train"), path)
    return t.spark.read.parquet(path).select("run_ts", "grp", "source", "metric", "value")


PARAM_DOC = {
    "target_groups": ["F", "O"],
    "min_group_samples": 200,
    "default_params": {"damping": 0.0, "pos_boost": 1.0, "alpha_smoothing": 0.7, "learning_rate": 0.05, "max_iter": 200, "max_depth": 4},
    "group_params_override": {"F__1-URGENT": {"damping": 0.5, "max_depth": 6}, "O__5-LOW": {"alpha_smoothing": 0.9}},
}


@query(
    "S10_group_params",
    """SELECT o_orderstatus AS "group", o_orderpriority AS surface, count(*) AS n,
      max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)::DOUBLE AS damping,
      max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 0.9 ELSE 0.7 END)::DOUBLE AS alpha_smoothing,
      max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 6 ELSE 4 END)::INTEGER AS max_depth
      FROM orders GROUP BY 1, 2""",
)
def group_params(t):
    path = scratch(t, "params")
    t.spark.createDataFrame([(json.dumps(PARAM_DOC),)], "doc string").coalesce(1).write.text(path)
    defaults, overrides = readers.group_params(t.spark, path)
    groups = t.orders.groupBy(F.col("o_orderstatus").alias("group"), F.col("o_orderpriority").alias("surface")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return readers.with_params(groups, defaults, overrides).select("group", "surface", "n", "damping", "alpha_smoothing", "max_depth")


# --- joins and strategy aggregates -------------------------------------------------------------

STRATEGIES = {
    "l_quantity": "mean",
    "l_extendedprice": "sum",
    "l_discount": "max",
    "l_tax": "min",
    "l_partkey": "first",
    "l_returnflag": "first_nonempty",
    "l_linestatus": "join_unique",
}
LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
ORD = "(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
AGG_SQL = f"""SELECT trim(l_orderkey::VARCHAR) AS k, {r('avg(l_quantity)')} AS l_quantity, {r('sum(l_extendedprice)', 2)} AS l_extendedprice,
  max(l_discount) AS l_discount, min(l_tax) AS l_tax, arg_min(l_partkey, {ORD}) AS l_partkey,
  arg_min(l_returnflag, {ORD}) AS l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS l_linestatus
  FROM lineitem GROUP BY 1"""


def lab(t, **kw):
    return merge.SubTable(t.lineitem, "l_orderkey", STRATEGIES, order=LINE_ORDER, **kw)


@query("A1_strategy_aggregate", AGG_SQL)
def strategy_aggregate(t):
    out = merge.aggregate_sub(lab(t)).withColumnRenamed("_key", "k")
    return rounded(out, 6, l_extendedprice=2)


@query(
    "A2_join_unique",
    "SELECT l_suppkey, string_agg(DISTINCT l_quantity::VARCHAR, ',' ORDER BY l_quantity::VARCHAR) AS seen FROM lineitem GROUP BY 1",
)
def join_unique(t):
    return t.lineitem.groupBy("l_suppkey").agg(merge.aggregate("join_unique", "l_quantity", ()).alias("seen"))


@query(
    "J1_key_normalisation",
    """SELECT o_orderstatus, count(*) AS matched FROM orders JOIN customer
      ON trim('  ' || o_custkey::VARCHAR || ' ') = trim(c_custkey::VARCHAR) GROUP BY 1""",
)
def key_normalisation(t):
    padded = t.orders.select("o_orderstatus", F.concat(F.lit("  "), F.col("o_custkey"), F.lit(" ")).alias("k"))
    return (
        padded.join(t.customer, scalar.join_key("k") == scalar.join_key("c_custkey"))
        .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("matched"))
    )


URGENT = "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(
    "J2_semi_prune",
    f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM ({URGENT})) GROUP BY 1",
)
def semi_prune(t):
    master = t.orders.where("o_orderpriority = '1-URGENT'")
    return merge.prune(t.lineitem, "l_orderkey", master, "o_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


MERGED = "o_orderkey, o_totalprice, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey::DOUBLE AS l_partkey, l_returnflag, l_linestatus"


def merged(t, **kw):
    out = merge.merge_one(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", lab(t, **kw))
    return rounded(out.withColumn("l_partkey", F.col("l_partkey").cast("double")), 6, l_extendedprice=2)


@query("J3_merge_inner", f"SELECT {MERGED} FROM orders JOIN ({AGG_SQL}) s ON o_orderkey::VARCHAR = k")
def merge_inner(t):
    return merged(t, unmatched="drop")


@query("J4_merge_left", f"SELECT {MERGED} FROM orders LEFT JOIN ({AGG_SQL}) s ON o_orderkey::VARCHAR = k")
def merge_left(t):
    return merged(t)


@query(
    "J5_collision_suffix",
    f"""SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice_sub FROM orders
      LEFT JOIN (SELECT o_custkey AS k, {r('avg(o_totalprice)', 8)} AS o_totalprice_sub FROM orders GROUP BY 1) ON o_custkey = k""",
)
def collision_suffix(t):
    sub = merge.SubTable(t.orders.withColumnRenamed("o_custkey", "sub_key"), "sub_key", {"o_totalprice": "mean"})
    out = merge.merge_one(t.orders, "o_custkey", sub)
    return rounded(out.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_totalprice_sub"), 8)


@query(
    "J6_chained_subs",
    f"""SELECT p_partkey, p_retailprice, qty, n_supp FROM part
      LEFT JOIN (SELECT l_partkey, {r('avg(l_quantity)')} AS qty FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey
      JOIN (SELECT l_partkey, max(l_suppkey) AS n_supp FROM lineitem GROUP BY 1) b ON b.l_partkey = p_partkey""",
)
def chained_subs(t):
    subs = [
        merge.SubTable(t.lineitem.withColumnRenamed("l_quantity", "qty"), "l_partkey", {"qty": "mean"}),
        merge.SubTable(t.lineitem.withColumnRenamed("l_suppkey", "n_supp"), "l_partkey", {"n_supp": "max"}, unmatched="drop"),
    ]
    return rounded(merge.merge_all(t.part.select("p_partkey", "p_retailprice"), "p_partkey", subs))


@query(
    "J7_all_null_drop",
    f"""SELECT o_orderkey, a, b FROM orders JOIN (SELECT l_orderkey, {r('max(CASE WHEN l_discount > 0.08 THEN l_discount END)')} AS a,
      {r('max(CASE WHEN l_tax > 0.07 THEN l_tax END)')} AS b FROM lineitem GROUP BY 1
      HAVING a IS NOT NULL OR b IS NOT NULL) ON o_orderkey = l_orderkey""",
)
def all_null_drop(t):
    rows = t.lineitem.select(
        "l_orderkey",
        F.when(F.col("l_discount") > 0.08, F.col("l_discount")).alias("a"),
        F.when(F.col("l_tax") > 0.07, F.col("l_tax")).alias("b"),
    )
    sub = merge.SubTable(rows, "l_orderkey", {"a": "max", "b": "max"}, all_null="drop", unmatched="drop")
    return rounded(merge.merge_one(t.orders.select("o_orderkey"), "o_orderkey", sub))


@query(
    "J8_ids_with_results",
    f"WITH {PAIRS_CTE} SELECT o_orderkey, o_orderpriority, {r('abs(delta)')} AS abs_residual FROM pairs",
)
def ids_with_results(t):
    return t.pairs.select("o_orderkey", "o_orderpriority", rnd(F.abs("delta")).alias("abs_residual"))


@query(
    "J9_map_lookup",
    "SELECT n_name AS nation, count(*) AS customers, " + r("avg(c_acctbal)", 4) + " AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def map_lookup(t):
    # Aggregating on the small integer first leaves one row per nation to look up.
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), rnd(F.avg("c_acctbal"), 4).alias("balance"))
    return per.join(t.nation, per["c_nationkey"] == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "customers", "balance")


@query("S1_key_duplicates", "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def key_duplicates(t):
    return merge.key_duplicates(t.lineitem, "l_orderkey")
