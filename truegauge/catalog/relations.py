"""Association measures (C) and hypothesis tests (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.registry import PAIRS_CTE, query, r, rounded, rs, sql_normal_quantile
from truegauge.catalog.shaping import BINNED
from truegauge.functions.scalar import effect_label, elapsed_days
from truegauge.operators import association, binning, diagnostics, information, splits
from truegauge.operators.lookup import attach

COLS = ["delta", "online", "qty", "disc", "lines"]


def numeric(t):
    return t.pairs.select("o_orderkey", "grp", *[F.col(c).cast("double").alias(c) for c in COLS])


def _matrix_sql(fn, cols, source, value):
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, {fn(a, b)} AS {value} FROM {source}" for a in cols for b in cols]
    return " UNION ALL ".join(cells)


@query("C1_pearson_matrix", f"WITH {PAIRS_CTE} " + _matrix_sql(lambda a, b: r(f"corr({a}, {b})"), COLS, "pairs", "r"))
def pearson_matrix(t):
    return rounded(association.pearson_matrix(numeric(t), COLS))


@query(
    "C1_pearson_against_delta",
    f"WITH {PAIRS_CTE} " + " UNION ALL ".join(f"SELECT grp, '{a}' AS feature, {r(f'corr({a}, delta)')} AS r FROM pairs GROUP BY 1" for a in COLS[1:]),
)
def pearson_against_delta(t):
    return rounded(association.against(association.pearson_matrix(numeric(t), COLS, ["grp"]), "delta"))


RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLS)


@query("C2_spearman_matrix", f"WITH {PAIRS_CTE}, rk AS (SELECT {RANKS} FROM pairs) " + _matrix_sql(lambda a, b: r(f"corr({a}, {b})"), COLS, "rk", "r"))
def spearman_matrix(t):
    return rounded(association.spearman_matrix(numeric(t), COLS, "o_orderkey"))


@query(
    "C3_pairwise_correlation",
    "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, " + r("corr(l_quantity, l_extendedprice)") + " AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', " + r("corr(l_discount, l_tax)") + " FROM lineitem",
)
def pairwise_correlation(t):
    return rounded(association.pairwise_correlation(t.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]))


def _bin_sql(c, q):
    tests = " + ".join(
        f"(CASE WHEN {c}__e{i} < {c}" + (f" AND {c}__e{i} <> {c}__e{i - 1}" if i else "") + " THEN 1 ELSE 0 END)" for i in range(q + 1)
    )
    return f"greatest(1, {tests}) AS {c}"


MI_EDGES = ", ".join(f"quantile_cont({c}, {i}/8.0::DOUBLE) AS {c}__e{i}" for c in COLS for i in range(9))
MI_CTE = f"WITH {PAIRS_CTE}, e AS (SELECT {MI_EDGES} FROM pairs), b AS (SELECT " + ", ".join(_bin_sql(c, 8) for c in COLS) + " FROM pairs, e)"


def _mi_cell(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, {r('sum(n / nn * ln(n * nn / (nx * ny)))')} AS mi FROM (
      SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS nn, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
      FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM b GROUP BY 1, 2))"""


@query("C4_mutual_information", MI_CTE + " " + " UNION ALL ".join(_mi_cell(a, "delta") for a in COLS[1:]))
def mutual_information(t):
    return rounded(association.mutual_information(numeric(t), [(a, "delta") for a in COLS[1:]], 8))


@query(
    "C5_mutual_information_matrix",
    MI_CTE + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{a}' AS b, 0.0::DOUBLE AS mi" if a == b else _mi_cell(a, b) for a in COLS[:4] for b in COLS[:4]),
)
def mutual_information_matrix(t):
    return rounded(association.mutual_information_matrix(numeric(t), COLS[:4], 8))


def _dcor_sql(a, b, source):
    return f"""SELECT '{a}' AS a, '{b}' AS b, {r('sqrt(avg(aa * bb) / sqrt(avg(aa * aa) * avg(bb * bb)))')} AS dcor FROM (
      SELECT dx - x1.mx - x2.mx + gx AS aa, dy - x1.my - x2.my + gy AS bb
      FROM (SELECT p.k AS i, q.k AS j, abs(p.{a} - q.{a}) AS dx, abs(p.{b} - q.{b}) AS dy FROM {source} p, {source} q) d
      JOIN (SELECT p.k AS i, avg(abs(p.{a} - q.{a})) AS mx, avg(abs(p.{b} - q.{b})) AS my FROM {source} p, {source} q GROUP BY 1) x1 ON x1.i = d.i
      JOIN (SELECT p.k AS i, avg(abs(p.{a} - q.{a})) AS mx, avg(abs(p.{b} - q.{b})) AS my FROM {source} p, {source} q GROUP BY 1) x2 ON x2.i = d.j,
      (SELECT avg(abs(p.{a} - q.{a})) AS gx, avg(abs(p.{b} - q.{b})) AS gy FROM {source} p, {source} q) g)"""


SMALL = "WITH s AS (SELECT p_partkey AS k, p_retailprice, p_size::DOUBLE AS p_size, length(p_name)::DOUBLE AS name_length FROM part)"


def small(t):
    return t.part.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), F.length("p_name").cast("double").alias("name_length"))


KNN_COLUMNS = ("charge", "price", "size", "amount")
KNN = f"""WITH q AS (SELECT p_partkey AS i, p_retailprice AS price, p_size::DOUBLE AS size, charge, amount FROM part JOIN (
    SELECT l_partkey, round(avg(l_extendedprice), 4) AS charge, round(avg(l_quantity), 6) AS amount FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
  cols AS (SELECT i, unnest(['charge', 'price', 'size', 'amount']) AS c, unnest([charge, price, size, amount]) AS v FROM q),
  dev AS (SELECT c, stddev_pop(v) AS s, count(*) AS n FROM cols GROUP BY 1),
  xy AS (SELECT a.i, a.c AS a, b.c AS b, a.v / p.s AS x, b.v / q.s AS y, p.n FROM cols a JOIN cols b ON a.i = b.i AND a.c = 'charge' AND b.c <> 'charge' JOIN dev p ON p.c = a.c JOIN dev q ON q.c = b.c),
  d AS (SELECT l.a, l.b, l.i, l.n, abs(l.x - r.x) AS dx, abs(l.y - r.y) AS dy, l.i = r.i AS own FROM xy l JOIN xy r ON l.a = r.a AND l.b = r.b),
  rho AS (SELECT a, b, i, (min(greatest(dx, dy), 3) FILTER (NOT own))[3] AS rho FROM d GROUP BY ALL),
  cnt AS (SELECT a, b, i, any_value(n) AS n, count(*) FILTER (dx <= rho * (1 - 1e-9::DOUBLE)) AS cx, count(*) FILTER (dy <= rho * (1 - 1e-9::DOUBLE)) AS cy,
    CASE WHEN any_value(rho) > 0 THEN 3 ELSE count(*) FILTER (dx = 0 AND dy = 0) END AS k FROM d JOIN rho USING (a, b, i) GROUP BY ALL),
  psi AS (SELECT n::BIGINT AS n, -0.57721566490153286::DOUBLE + coalesce(sum(1.0::DOUBLE / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi
    FROM (SELECT unnest(range(2, (SELECT max(n) + 1 FROM dev))) AS n) UNION ALL SELECT 1, -0.57721566490153286::DOUBLE),
  mi AS (SELECT a, b, greatest(0, avg(pn.psi + pk.psi - px.psi - py.psi)) AS mi FROM cnt JOIN psi pn ON pn.n = cnt.n JOIN psi pk ON pk.n = k JOIN psi px ON px.n = cx JOIN psi py ON py.n = cy GROUP BY 1, 2)"""


def part_rows(t):
    """Parts with the mean price and quantity of their lines."""
    lines = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("charge"), F.round(F.avg("l_quantity"), 6).alias("amount"))
    rows = t.part.join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), "charge", "amount")


@query("C4_knn_information", KNN + f" SELECT b AS feature, {r('mi', 8)} AS mi FROM mi")
def knn_information(t):
    """Information of each feature about the mean charge, by three nearest neighbours."""
    found = information.neighbour_information(part_rows(t), [(c, "charge") for c in KNN_COLUMNS[1:]])
    return rounded(found.select(F.col("a").alias("feature"), "mi"), 8)


KNN_ALL = KNN.replace("a.c = 'charge' AND b.c <> 'charge'", "a.c < b.c")


@query("C5_knn_matrix", KNN_ALL + f" SELECT a, b, {r('mi', 8)} AS mi FROM mi UNION ALL SELECT b, a, {r('mi', 8)} FROM mi UNION ALL SELECT c, c, 0.0::DOUBLE FROM dev")
def knn_matrix(t):
    """All pairs in both directions, zero with themselves."""
    return rounded(information.information_matrix(part_rows(t), KNN_COLUMNS), 8)


@query("C6_distance_correlation", f"{SMALL} {_dcor_sql('p_size', 'p_retailprice', 's')} UNION ALL {_dcor_sql('name_length', 'p_retailprice', 's')}")
def distance_correlation(t):
    return rounded(association.distance_correlation(small(t), "p_partkey", [("p_size", "p_retailprice"), ("name_length", "p_retailprice")]))


TRIPLE = ("p_size", "p_retailprice", "name_length")


@query(
    "C7_distance_correlation_matrix",
    SMALL + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS dcor" if a == b else _dcor_sql(a, b, "s") for a in TRIPLE for b in TRIPLE),
)
def distance_correlation_matrix(t):
    return rounded(association.distance_correlation_matrix(small(t), "p_partkey", list(TRIPLE)))


def _dcor_sums(a, b):
    """The definition expanded into row means, so that the pairs are aggregated as they are formed."""

    def v(xy, x, y):
        return f"(avg({xy}) - 2 * avg({x} * {y}) + avg({x}) * avg({y}))"

    return f"""SELECT '{a}' AS a, '{b}' AS b, {r(f"sqrt({v('ab', 'ma', 'mb')} / sqrt({v('aa', 'ma', 'ma')} * {v('bb', 'mb', 'mb')}))")} AS dcor FROM (
      SELECT avg(abs(p.{a} - q.{a})) AS ma, avg(abs(p.{b} - q.{b})) AS mb, avg(abs(p.{a} - q.{a}) * abs(p.{b} - q.{b})) AS ab,
        avg(pow(p.{a} - q.{a}, 2)) AS aa, avg(pow(p.{b} - q.{b}, 2)) AS bb FROM pairs p, pairs q GROUP BY p.o_orderkey)"""


@query("C6_distance_correlation_orders", f"WITH {PAIRS_CTE} {_dcor_sums('online', 'delta')} UNION ALL {_dcor_sums('qty', 'delta')}")
def distance_correlation_orders(t):
    """The same on the order table, many blocks long at scale."""
    return rounded(association.distance_correlation(numeric(t), "o_orderkey", [("online", "delta"), ("qty", "delta")]))


@query(
    "C8_H14_mann_whitney",
    f"""WITH rk AS (SELECT l_returnflag, l_discount > 0.05 AS f, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rk
        FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)),
      s AS (SELECT l_returnflag, count(*) FILTER (f) AS n_first, count(*) FILTER (NOT f) AS n_rest, sum(rk) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u FROM rk GROUP BY 1)
      SELECT l_returnflag, n_first, n_rest, {rs(6, u='u', cliffs_delta='2 * u / (n_first * n_rest) - 1')},
        CASE WHEN abs(2 * u / (n_first * n_rest) - 1) < 0.147 THEN 'negligible' WHEN abs(2 * u / (n_first * n_rest) - 1) < 0.33 THEN 'small' ELSE 'larger' END AS label FROM s""",
)
def mann_whitney(t):
    out = association.mann_whitney(t.lineitem.withColumn("f", F.col("l_discount") > 0.05), "l_extendedprice", "f", ["l_returnflag"])
    return rounded(out.withColumn("label", effect_label(F.col("cliffs_delta"))))


#: Orders split into dear and cheap discounts; ``masks`` holds every way to choose as many lines of an order, ``o`` their places and doubled ranks.
CHOICES = """l AS (SELECT l_orderkey, l_extendedprice AS v, l_discount > 0.05 AS f FROM lineitem),
  o AS (SELECT l_orderkey, v, f, row_number() OVER (PARTITION BY l_orderkey ORDER BY v) - 1 AS i, 2 * rank() OVER (PARTITION BY l_orderkey ORDER BY v) + count(*) OVER (PARTITION BY l_orderkey, v) - 1 AS r2 FROM l),
  g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (f) AS n_first, count(*) FILTER (NOT f) AS n_rest, sum(r2) FILTER (f) AS w FROM o GROUP BY 1 HAVING count(DISTINCT f) = 2),
  masks AS (SELECT * FROM (SELECT l_orderkey, n_first, n_rest, unnest(range(1 << n)) AS mask FROM g) WHERE bit_count(mask) = n_first)"""


def lines_by_discount(t):
    return t.lineitem.select("l_orderkey", "l_extendedprice", (F.col("l_discount") > 0.05).alias("f"))


@query(
    "H14_rank_sum_p",
    f"""WITH {CHOICES},
      s AS (SELECT l_orderkey, mask, sum(r2) AS s FROM masks JOIN o USING (l_orderkey) WHERE (mask >> i) & 1 = 1 GROUP BY 1, 2),
      p AS (SELECT l_orderkey, avg((s <= w)::INTEGER) AS low, avg((s >= w)::INTEGER) AS high FROM s JOIN g USING (l_orderkey) GROUP BY 1),
      e AS (SELECT l_orderkey, sum(t * t * t - t) AS ties FROM (SELECT l_orderkey, count(*)::DOUBLE AS t FROM o GROUP BY l_orderkey, v) GROUP BY 1),
      q AS (SELECT *, w / 2.0::DOUBLE - n_first * (n_first + 1) / 2.0::DOUBLE AS u, sqrt(n_first * n_rest / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))) AS sd FROM g JOIN p USING (l_orderkey) JOIN e USING (l_orderkey))
      SELECT l_orderkey, n_first, n_rest, true AS exact, {rs(6, u='u', z='CASE WHEN sd > 0 THEN greatest(abs(u - n_first * n_rest / 2.0::DOUBLE) - 0.5, 0) / sd END', p_value='least(1, 2 * least(low, high))')} FROM q""",
)
def rank_sum_p(t):
    return rounded(association.rank_sum_test(lines_by_discount(t), "l_extendedprice", "f", ["l_orderkey"]).where("n_first > 0 and n_rest > 0"))


LOWESS_SQL = f"""WITH {PAIRS_CTE}, o AS (SELECT online AS x, delta AS y, row_number() OVER (ORDER BY online, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM pairs),
  w AS (SELECT a.x AS x0, b.x AS x1 FROM o a JOIN o b ON b.i = a.i + floor(0.3::DOUBLE * a.n)::BIGINT - 1),
  g AS (SELECT j::INTEGER AS point, x AS gx FROM range(101) AS js(j) JOIN o ON i = j * (n - 1) // 100),
  h AS (SELECT point, gx, min(greatest(gx - x0, x1 - gx)) AS h FROM g, w GROUP BY 1, 2),
  s AS (SELECT point, gx, x - gx AS d, y, CASE WHEN abs(x - gx) < h THEN pow(1 - pow(abs(x - gx) / h, 3), 3) ELSE 0 END AS w FROM h, o)
  SELECT point, {r('any_value(gx)')} AS x, {r('(sum(w * y) * sum(w * d * d) - sum(w * d) * sum(w * d * y)) / (sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d))', 4)} AS fitted FROM s GROUP BY 1"""


@query("C9_lowess_curve", LOWESS_SQL)
def lowess_curve(t):
    return rounded(association.lowess(numeric(t), "online", "delta", "o_orderkey", robust=0), 6, fitted=4)


_fit = "(sum(w * y) * sum(w * d * d) - sum(w * d) * sum(w * d * y)) / (sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d))"
SUMMARY_SQL = LOWESS_SQL[: LOWESS_SQL.index("  SELECT point, (round(")] + f""", c AS (SELECT point, any_value(gx) AS x, {_fit} AS fitted FROM s GROUP BY 1),
  m AS (SELECT *, x - avg(x) OVER () AS c FROM c),
  a AS (SELECT regr_slope(fitted, x) AS slope, max(fitted) - min(fitted) AS ry, max(x) - min(x) AS rx, arg_min(x, abs(fitted)) AS extreme_x, arg_min(fitted, abs(fitted)) AS extreme_delta,
    max(fitted) FILTER (point = 5) AS lo, max(fitted) FILTER (point = 95) AS hi, count(*)::DOUBLE AS n, sum(c * c) AS s2, sum(c * c * c) AS s3, sum(c * c * c * c) AS s4,
    sum(fitted) AS sy, sum(c * fitted) AS sxy, sum(c * c * fitted) AS sx2y FROM m),
  q AS (SELECT *, (n * (s2 * sx2y - s3 * sxy) - s2 * s2 * sy) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) AS quad FROM a)
  SELECT CASE WHEN abs(slope) < 0.001 * ry / (rx + 1e-10) THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction,
    CASE WHEN quad > 0 THEN 'U' WHEN quad < 0 THEN 'inverted U' ELSE 'linear' END AS shape, {rs(6, slope='slope')}, {r('quad * 1e6', 4)} AS quadratic,
    {rs(4, extreme_x='extreme_x', extreme_delta='extreme_delta', delta_range='abs(hi - lo)')} FROM q"""


@query("C9_lowess_summary_plain", SUMMARY_SQL)
def lowess_summary_plain(t):
    curve = association.lowess(numeric(t), "online", "delta", "o_orderkey", robust=0)
    out = association.lowess_summary(curve).withColumn("quadratic", F.col("quadratic") * 1e6)
    return rounded(out, 4, slope=6)


@query("C9_lowess_summary")
def lowess_summary(t):
    curve = association.lowess(numeric(t), "online", "delta", "o_orderkey", robust=3)
    return rounded(association.lowess_summary(curve))


DAYS = "(epoch_us(o_orderdate) - (SELECT min(epoch_us(o_orderdate)) FROM pairs)) / 86400000000.0::DOUBLE"


@query(
    "C10_time_trend",
    f"""WITH {PAIRS_CTE}, d AS (SELECT grp, delta, {DAYS} AS days FROM pairs),
      f AS (SELECT grp, count(*) AS n, regr_slope(delta, days) AS slope, corr(delta, days) AS c FROM d GROUP BY 1)
      SELECT grp, n, {rs(6, slope='slope', r='c', t='c * sqrt((n - 2) / (1 - c * c))')} FROM f WHERE n >= 10""",
)
def time_trend(t):
    p = attach(t.pairs, t.pairs.agg(F.min("o_orderdate").alias("t0"))).withColumn("days", elapsed_days(F.col("o_orderdate"), F.col("t0")))
    return rounded(association.time_trend(p, "delta", "days", ["grp"]).drop("p_value", "significant"))


@query(
    "C11_capability",
    f"""WITH {PAIRS_CTE} SELECT grp, {r('least((500000.0 - avg(delta)) / (3 * stddev_samp(delta)), (avg(delta) + 500000.0) / (3 * stddev_samp(delta)))')} AS cpk,
      {r('least((500000.0 - avg(delta)) / (3 * stddev_samp(delta)), (avg(delta) + 500000.0) / (3 * stddev_samp(delta)))')} AS ppk FROM pairs GROUP BY 1""",
)
def capability(t):
    return rounded(association.capability(t.pairs, "delta", -500000.0, 500000.0, ["grp"]))


# --- hypothesis tests ---------------------------------------------------------------------------

K2_SQL = f"""WITH {PAIRS_CTE}, m AS (SELECT grp, avg(delta) AS mu FROM pairs GROUP BY 1),
  c AS (SELECT grp, count(*)::DOUBLE AS n, any_value(mu) AS mu, stddev_samp(delta) AS sd, avg(abs(delta)) AS mae, avg(pow(delta - mu, 2)) AS m2, avg(pow(delta - mu, 3)) AS m3, avg(pow(delta - mu, 4)) AS m4 FROM pairs JOIN m USING (grp) GROUP BY 1),
  s AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c),
  a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM s),
  b AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM a),
  z AS (SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt(pow(y / sqrt(2 / (w2 - 1)), 2) + 1)) / sqrt(0.5 * ln(w2)) AS z1,
    (1 - 2 / (9 * aa) - sign(1 + x * sqrt(2 / (aa - 4))) * cbrt((1 - 2 / aa) / abs(1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM b)
  SELECT grp, n::BIGINT AS n, {rs(4, mean='mu', std='sd', mae='mae', skew='g1', kurtosis='b2 - 3', k2='z1 * z1 + z2 * z2', k2_p='exp(-(z1 * z1 + z2 * z2) / 2)')},
    exp(-(z1 * z1 + z2 * z2) / 2) < 0.05 AS not_normal FROM z"""


@query("H1_H3_normality", K2_SQL)
def normality(t):
    return rounded(diagnostics.normality(t.pairs, "delta", ["grp"]), 4)


SW_SQL = f"""WITH {PAIRS_CTE}, o AS (SELECT grp, delta AS x, row_number() OVER (PARTITION BY grp ORDER BY delta, o_orderkey) AS i, count(*) OVER (PARTITION BY grp) AS n FROM pairs),
  p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM o),
  z AS (SELECT *, {sql_normal_quantile('p')} AS m FROM p),
  g AS (SELECT grp, any_value(n) AS n, sum(m * m) AS mm, max(m) AS ml, max(m) FILTER (i = n - 1) AS mp, max(x) FILTER (i = n) AS x1, max(x) FILTER (i = n - 1) AS x2,
    max(x) FILTER (i = 1) AS y1, max(x) FILTER (i = 2) AS y2, sum(m * x) FILTER (i > 2 AND i < n - 1) AS mx, var_pop(x) * count(*) AS ss, 1 / sqrt(any_value(n)) AS u FROM z GROUP BY 1),
  a AS (SELECT *, 0.221157 * u - 0.147981 * pow(u, 2) - 2.07119 * pow(u, 3) + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5) + ml / sqrt(mm) AS a1,
    0.042981 * u - 0.293762 * pow(u, 2) - 1.752461 * pow(u, 3) + 5.682633 * pow(u, 4) - 3.582633 * pow(u, 5) + mp / sqrt(mm) AS a2 FROM g),
  f AS (SELECT *, a1 * (x1 - y1) + a2 * (x2 - y2) + mx / sqrt((mm - 2 * ml * ml - 2 * mp * mp) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS t FROM a)
  SELECT grp, n, {r('t * t / ss')} AS w FROM f"""


@query("H2_shapiro_wilk_statistic", SW_SQL)
def shapiro_wilk_statistic(t):
    return rounded(diagnostics.shapiro_wilk(t.pairs, "delta", ["o_orderkey"], ["grp"]).drop("w_p", "p_in_range"))


@query("H2_shapiro_wilk")
def shapiro_wilk(t):
    return rounded(diagnostics.shapiro_wilk(t.pairs, "delta", ["o_orderkey"], ["grp"]))


def anova_sql(source, group, value, by="", rename="", keep_n=3):
    b = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON true"
    g = f"GROUP BY {by}" if by else ""
    return f"""per AS (SELECT {b}{group} AS gg, count(*) AS n, avg({value}) AS m, var_pop({value}) * count(*) AS ssw FROM {source} GROUP BY ALL HAVING count(*) >= {keep_n}),
  tot AS (SELECT {b}count(*) AS k, sum(n) AS n, sum(ssw) AS ssw, sum(n * m) / sum(n) AS gm FROM per {g}),
  btw AS (SELECT {('per.' + by + ', ') if by else ''}sum(per.n * pow(m - gm, 2)) AS ssb FROM per JOIN tot {j} {('GROUP BY per.' + by) if by else ''})
  SELECT {b}k AS groups, tot.n::BIGINT AS n, {r('(ssb / (k - 1)) / (ssw / (tot.n - k))', 5)} AS f, k - 1 AS df_between, (tot.n - k)::BIGINT AS df_within{rename} FROM tot JOIN btw {j}"""


@query("H4_levene", BINNED + ", bm AS (SELECT grp, bin, median(truth) AS med FROM b GROUP BY 1, 2), dv AS (SELECT grp, bin, abs(truth - med) AS dev FROM b JOIN bm USING (grp, bin)), " + anova_sql("dv", "bin", "dev", "grp"))
def levene(t):
    return rounded(diagnostics.heteroscedasticity(t.pairs.select("grp", "delta", "truth"), "delta", "truth", 8, ["grp"]), 5)


ROLE = "CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) - 1 < count(*) OVER (PARTITION BY grp) - ceil(count(*) OVER (PARTITION BY grp) * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS role"
ROLES = f"WITH {PAIRS_CTE}, o AS (SELECT *, {ROLE} FROM pairs)"


def roles(t):
    return splits.ordered_holdout(t.pairs.drop("o_custkey"), ["o_orderdate", "o_orderkey"], 0.2, ["grp"])


@query(
    "H5_overfit_ratio",
    ROLES + f" SELECT grp, {rs(4, mae_train='''avg(abs(delta)) FILTER (role = 'train')''', mae_test='''avg(abs(delta)) FILTER (role = 'test')''', overfit_ratio='''avg(abs(delta)) FILTER (role = 'test') / greatest(avg(abs(delta)) FILTER (role = 'train'), 1e-6)''')} FROM o GROUP BY 1",
)
def overfit_ratio(t):
    return rounded(diagnostics.overfit_ratio(roles(t), "delta", "role", ["grp"]), 4)


@query("H6_anova_feature_bins", BINNED + ", " + anova_sql("b", "bin", "truth", "grp"))
def anova_feature_bins(t):
    binned = binning.quantile_bins(t.pairs.select("grp", "delta", "truth"), "delta", 8, ["grp"])
    return rounded(diagnostics.anova(binned, "bin", "truth", ["grp"]), 5)


@query("H7_anova_categorical", f"WITH {PAIRS_CTE}, " + anova_sql("pairs", "o_orderpriority", "delta", "o_orderstatus"))
def anova_categorical(t):
    return rounded(diagnostics.anova(t.pairs, "o_orderpriority", "delta", ["o_orderstatus"]), 5)


def _feature_f(c):
    return f"""SELECT '{c}' AS feature, * FROM (WITH e AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, {i}/8.0::DOUBLE) AS {c}__e{i}' for i in range(9))} FROM pairs),
      fb AS (SELECT delta, {_bin_sql(c, 8).replace(f' AS {c}', ' AS bin')} FROM pairs, e), {anova_sql('fb', 'bin', 'delta')})"""


@query(
    "H8_feature_significance",
    f"WITH {PAIRS_CTE} SELECT feature, kind, groups, n, f, row_number() OVER (ORDER BY f DESC) = 1 AS strongest FROM ("
    + " UNION ALL ".join(f"SELECT *, 'numeric' AS kind FROM ({_feature_f(c)})" for c in ("online", "qty", "disc"))
    + f" UNION ALL SELECT 'grp' AS feature, *, 'categorical' AS kind FROM (WITH {anova_sql('pairs', 'grp', 'delta')}))",
)
def feature_significance(t):
    out = diagnostics.feature_tests(numeric(t), "delta", ["online", "qty", "disc"], ["grp"])
    best = out.agg(F.max_by("feature", "f").alias("_best"))
    return rounded(attach(out, best).select("feature", "kind", "groups", "n", "f", (F.col("feature") == F.col("_best")).alias("strongest")), 5)


@query(
    "H9_ljung_box",
    f"""WITH o AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS x, count(*) OVER (PARTITION BY event_type) AS n,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
      v AS (SELECT event_type, sum(x * x) AS ss, any_value(n) AS n FROM o GROUP BY 1),
      c AS (SELECT a.event_type, k, sum(a.x * b.x) / any_value(ss) AS rho, any_value(v.n) AS n FROM o a, range(1, 11) AS ks(k)
        JOIN o b ON b.event_type = a.event_type AND b.i = a.i - k JOIN v ON v.event_type = a.event_type GROUP BY 1, 2)
      SELECT event_type, any_value(n) AS n, count(*) AS lags, {r('any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - k))')} AS q FROM c GROUP BY 1""",
)
def ljung_box(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(diagnostics.ljung_box(e, "value", ["ts", "event_id"], ["event_type"]).drop("p_value"))


KOL = "greatest(0, least(1, list_sum([(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2 * k * k * lam * lam) for k in range(1, 61)])))"


def ks_sql(source, value, role, first, by):
    return f"""cnt AS (SELECT {by}, {value} AS v, count(*) FILTER ({role} = '{first}') AS a, count(*) FILTER ({role} <> '{first}') AS b FROM {source} GROUP BY 1, 2),
  cum AS (SELECT {by}, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY {by}) AS na, sum(b) OVER (PARTITION BY {by}) AS nb FROM cnt WINDOW w AS (PARTITION BY {by} ORDER BY v)),
  ks AS (SELECT {by}, any_value(na)::BIGINT AS n_first, any_value(nb)::BIGINT AS n_second, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS ks FROM cum GROUP BY 1),
  kp AS (SELECT *, ks * sqrt(n_first::DOUBLE * n_second / (n_first + n_second)) AS lam FROM ks),
  kk AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE {KOL} END AS ks_p FROM kp)"""


@query("H11_two_sample_ks", ROLES + ", " + ks_sql("o", "delta", "role", "train", "grp") + f" SELECT grp, n_first, n_second, {rs(6, ks='ks', ks_p='ks_p')} FROM kk")
def two_sample_ks(t):
    return rounded(diagnostics.two_sample_ks(roles(t), "delta", "role", "train", ["grp"]))


@query(
    "H11_exact_two_sample_ks",
    f"""WITH {CHOICES},
      c AS (SELECT l_orderkey, v, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM l JOIN g USING (l_orderkey) GROUP BY 1, 2),
      d AS (SELECT l_orderkey, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY v)),
      k AS (SELECT l_orderkey, n_first, n_rest, max(abs(ca * n_rest - cb * n_first)) AS gap FROM d JOIN g USING (l_orderkey) GROUP BY 1, 2, 3),
      m AS (SELECT l_orderkey, mask, n_first, n_rest, i, sum((mask >> i) & 1) OVER (PARTITION BY l_orderkey, mask ORDER BY i) AS x FROM masks JOIN o USING (l_orderkey)),
      h AS (SELECT l_orderkey, mask, max(abs(x * n_rest - (i + 1 - x) * n_first)) AS gap FROM m GROUP BY 1, 2)
      SELECT l_orderkey, n_first, n_rest AS n_second, {rs(6, ks='any_value(k.gap)::DOUBLE / (n_first * n_rest)', ks_p='avg((h.gap >= k.gap)::INTEGER)')} FROM k JOIN h USING (l_orderkey) GROUP BY 1, 2, 3""",
)
def exact_two_sample_ks(t):
    rows = lines_by_discount(t).withColumn("side", F.when(F.col("f"), "dear").otherwise("cheap"))
    return rounded(diagnostics.two_sample_ks(rows, "l_extendedprice", "side", "dear", ["l_orderkey"], min_rows=1, exact=True).where("n_first > 0 and n_second > 0"))


@query(
    "H12_drift_verdict",
    f"""WITH {PAIRS_CTE}, o AS (SELECT grp, delta, CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) - 1 < floor(count(*) OVER (PARTITION BY grp) * 0.8::DOUBLE) THEN 'early' ELSE 'late' END AS role FROM pairs),
      {ks_sql('o', 'delta', 'role', 'early', 'grp')},
      st AS (SELECT grp, count(*) AS rows, {rs(4, mean='avg(delta)', std='stddev_pop(delta)', mean_early='''avg(delta) FILTER (role = 'early')''', mean_late='''avg(delta) FILTER (role = 'late')''', mean_diff='''avg(delta) FILTER (role = 'late') - avg(delta) FILTER (role = 'early')''', std_ratio='''stddev_pop(delta) FILTER (role = 'late') / (stddev_pop(delta) FILTER (role = 'early') + 1e-8)''')} FROM o GROUP BY 1)
      SELECT st.*, {rs(4, ks='ks', ks_p='ks_p')}, CASE WHEN ks_p < 0.01 AND abs(mean_diff) > 0.05 THEN 'clear drift' WHEN ks_p < 0.05 THEN 'suspicious drift' ELSE 'stable' END AS verdict FROM st JOIN kk USING (grp)""",
)
def drift_verdict(t):
    p = t.pairs.select("grp", "o_orderdate", "o_orderkey", "delta")
    return rounded(diagnostics.drift(p, "delta", ["o_orderdate", "o_orderkey"], ["grp"]), 4)


@query("H13_mean_tests", f"WITH {PAIRS_CTE} SELECT grp, count(*) AS n, {rs(4, mean='avg(delta)', std='stddev_samp(delta)', t='avg(delta) / (stddev_samp(delta) / sqrt(count(*)))')} FROM pairs GROUP BY 1 HAVING count(*) >= 10")
def mean_tests(t):
    return rounded(diagnostics.mean_tests(t.pairs, "delta", ["grp"]).drop("p_value", "significant"), 4)


@query(
    "H15_role_comparison",
    ROLES + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, role FROM o" for c in COLS) + "), "
    + ks_sql("l", "x", "role", "train", "feature") + f" SELECT feature, n_first, n_second, {rs(6, ks='ks', ks_p='ks_p')} FROM kk",
)
def role_comparison(t):
    return rounded(diagnostics.compare_roles(roles(t), COLS, "role", "train"))
