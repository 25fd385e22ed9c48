"""Registered queries and their SQL twins on the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.functions.tails import CENTRE, FAR, SHOULDER
from truegauge.session import prepare
from truegauge.spec import Spec, Surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one data folder, and the role bindings built on them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def sub(self) -> DataFrame:
        charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        currents = [
            F.round(F.sum(F.when(F.col("l_linenumber") == i, F.col("l_extendedprice"))), 2).alias(f"i{i}") for i in range(1, 8)
        ]
        return self.lineitem.groupBy("l_orderkey").agg(
            F.round(F.sum(charge), 6).alias("charge"),
            F.round(F.sum(net), 4).alias("net"),
            F.sum("l_quantity").alias("qty"),
            F.round(F.avg("l_quantity"), 6).alias("qty_avg"),
            F.round(F.avg("l_discount"), 6).alias("disc"),
            F.max("l_discount").alias("disc_max"),
            F.max("l_tax").alias("tax_max"),
            F.count(F.lit(1)).alias("lines"),
            *currents,
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Orders (online) with aggregated line items (truth), inner."""
        joined = self.orders.join(self.sub, F.col("o_orderkey") == F.col("l_orderkey"))
        return joined.select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
            F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("grp"),
            F.col("o_totalprice").alias("online"), F.col("charge").alias("truth"),
            F.round(F.col("charge") - F.col("o_totalprice"), 6).alias("delta"),
            "qty", "disc", "lines",
        )

    @cached_property
    def coils(self) -> DataFrame:
        """Two-surface coil table: orders as coils, left-joined line items as instruments and laboratory."""
        j = self.orders.join(self.sub, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        online_top = F.col("o_totalprice") / 100000.0
        online_bot = F.col("o_totalprice") / 80000.0
        return j.select(
            F.col("o_orderkey").alias("coil_id"),
            F.col("o_orderdate").alias("produce_time"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("grade"),
            F.when(F.col("qty_avg") < 6, 0.0).otherwise(F.col("qty_avg") * 4.0).alias("speed"),
            (F.lit(700.0) + F.col("o_totalprice") / 1000.0).alias("width"),
            (F.lit(0.2) + F.col("disc_max")).alias("thickness"),
            *[f"i{i}" for i in range(1, 8)],
            F.when(F.col("o_orderstatus") == "F", 1.1).when(F.col("o_orderstatus") == "O", 2.0).otherwise(2.8).alias("top_set"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1.1)
            .when(F.col("o_orderpriority") == "2-HIGH", 2.0)
            .when(F.col("o_orderpriority") == "3-MEDIUM", 2.799)
            .when(F.col("o_orderpriority") == "5-LOW", 5.6)
            .alias("bot_set"),
            online_top.alias("top_avg"),
            F.when(F.col("tax_max") == 0, 0.0).otherwise(online_top - F.col("disc_max")).alias("top_min"),
            (online_top + F.col("tax_max") * 4.0).alias("top_max"),
            online_bot.alias("bot_avg"),
            (online_bot - F.col("disc_max") * 2.0).alias("bot_min"),
            (online_bot + F.col("tax_max") * 3.0).alias("bot_max"),
            F.round(F.col("charge") / 100000.0, 11).alias("top_truth"),
            F.round(F.col("net") / 80000.0, 11).alias("bot_truth"),
        )


COIL_SPEC = Spec(
    key="coil_id",
    time="produce_time",
    grade="grade",
    speed="speed",
    width_mm="width",
    thickness="thickness",
    surfaces=(
        Surface("Top", "top_avg", "top_min", "top_max", "top_truth", "top_set", ("i2", "i4", "i6")),
        Surface("Bot", "bot_avg", "bot_min", "bot_max", "bot_truth", "bot_set", ("i1", "i3", "i5", "i7")),
    ),
)

SUB_CTE = """sub AS (
  SELECT l_orderkey,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS charge,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS net,
    sum(l_quantity) AS qty, round(avg(l_quantity), 6) AS qty_avg, round(avg(l_discount), 6) AS disc,
    max(l_discount) AS disc_max, max(l_tax) AS tax_max, count(*) AS lines,
    """ + ", ".join(f"round(sum(CASE WHEN l_linenumber = {i} THEN l_extendedprice END), 2) AS i{i}" for i in range(1, 8)) + """
  FROM lineitem GROUP BY l_orderkey)"""

PAIRS_CTE = SUB_CTE + """, pairs AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority,
    o_orderstatus || '_' || o_orderpriority AS grp, o_totalprice AS online, charge AS truth,
    round(charge - o_totalprice, 6) AS delta, qty, disc, lines
  FROM orders JOIN sub ON o_orderkey = l_orderkey)"""

COILS_CTE = SUB_CTE + """, coils AS (
  SELECT o_orderkey AS coil_id, o_orderdate AS produce_time,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS grade,
    CASE WHEN qty_avg < 6 THEN 0.0::DOUBLE ELSE qty_avg * 4.0::DOUBLE END AS speed,
    700.0::DOUBLE + o_totalprice / 1000.0::DOUBLE AS width,
    0.2::DOUBLE + disc_max AS thickness, i1, i2, i3, i4, i5, i6, i7,
    CASE o_orderstatus WHEN 'F' THEN 1.1::DOUBLE WHEN 'O' THEN 2.0::DOUBLE ELSE 2.8::DOUBLE END AS top_set,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1.1::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE
      WHEN '3-MEDIUM' THEN 2.799::DOUBLE WHEN '5-LOW' THEN 5.6::DOUBLE END AS bot_set,
    o_totalprice / 1e5 AS top_avg,
    CASE WHEN tax_max = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 1e5 - disc_max END AS top_min,
    o_totalprice / 1e5 + tax_max * 4.0::DOUBLE AS top_max,
    o_totalprice / 8e4 AS bot_avg, o_totalprice / 8e4 - disc_max * 2.0::DOUBLE AS bot_min,
    o_totalprice / 8e4 + tax_max * 3.0::DOUBLE AS bot_max,
    round(charge / 1e5, 11) AS top_truth, round(net / 8e4, 11) AS bot_truth
  FROM orders LEFT JOIN sub ON o_orderkey = l_orderkey)"""

DERIVED_CTE = COILS_CTE + """, sums AS (
  SELECT *, coalesce(i2, 0) + coalesce(i4, 0) + coalesce(i6, 0) AS top_current_sum,
    coalesce(i1, 0) + coalesce(i3, 0) + coalesce(i5, 0) + coalesce(i7, 0) AS bot_current_sum,
    width / 1000.0::DOUBLE AS width_m, nullif(speed, 0) AS sp FROM coils),
derived AS (
  SELECT *, top_current_sum / sp AS top_current_per_speed, bot_current_sum / sp AS bot_current_per_speed,
    top_current_sum / (sp * width_m) AS top_factor, bot_current_sum / (sp * width_m) AS bot_factor,
    top_set - top_avg AS top_deviation, bot_set - bot_avg AS bot_deviation,
    top_truth - top_avg AS top_delta, bot_truth - bot_avg AS bot_delta FROM sums)"""

# Per-surface long form of the derived coils, group label included.
LONG_CTE = DERIVED_CTE + """, long AS (
  SELECT coil_id, produce_time, grade, speed, 'Top' || top_set || '_Bot' || bot_set AS setpoint_group,
    'Top' AS surface, top_avg AS online, top_truth AS truth, top_delta AS delta, top_deviation AS deviation FROM derived
  UNION ALL
  SELECT coil_id, produce_time, grade, speed, 'Top' || top_set || '_Bot' || bot_set,
    'Bot', bot_avg, bot_truth, bot_delta, bot_deviation FROM derived)"""
LONG_CTE = LONG_CTE.replace("'Top' || top_set || '_Bot' || bot_set", "'Top' || top_set::VARCHAR || '_Bot' || bot_set::VARCHAR")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn):
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round a float for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` sets digits per column)."""
    return df.select(
        *[rnd(n, special.get(n, digits)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    )


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def rs(digits: int = 6, **exprs: str) -> str:
    """Several rounded select items, ``name=expression``."""
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in exprs.items())


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def sql_normal_quantile(p: str) -> str:
    """SQL twin of the normal quantile expression."""
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    parts = []
    for (num, den), x in ((CENTRE, f"(0.180625 - {q} * {q})"), (SHOULDER, f"({r} - 1.6)"), (FAR, f"({r} - 5)")):
        parts.append(f"{_horner(num, x)} / {_horner(den, x)}")
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {parts[0]} WHEN {r} <= 5 THEN sign({q}) * {parts[1]} ELSE sign({q}) * {parts[2]} END"


def text_time(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def sql_time(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
