"""Ordered and window operators (W), splits by order (M1, M3), elapsed time."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.registry import PAIRS_CTE, query, r, rounded, text_time
from truegauge.operators.lookup import attach
from truegauge.operators import incidence, ordered, quantiles, shaping, splits

EV = "event_type, ts, event_id"


@query("W1_group_ordinal", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events")
def group_ordinal(t):
    return ordered.with_ordinal(t.events.select("event_type", "ts", "event_id"), ["ts", "event_id"], ["event_type"]).select("event_id", "idx")


@query("W1_global_ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def global_ordinal(t):
    return ordered.with_ordinal(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


ROLL = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query(
    "W2_rolling_trailing",
    f"""SELECT event_id, {r(f'CASE WHEN count(value) {ROLL} >= 12 THEN avg(value) {ROLL} END', 9)} AS roll_mean,
      {r(f'CASE WHEN count(value) {ROLL} >= 12 THEN stddev_samp(value) {ROLL} END', 7)} AS roll_std FROM events""",
)
def rolling_trailing(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(ordered.rolling_stats(e, "value", ["ts", "event_id"], ["event_type"], 50).select("event_id", "roll_mean", "roll_std"), 9, roll_std=7)


@query(
    "W3_rolling_centred",
    f"""SELECT event_id, {r('CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END', 9)} AS trend FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING)""",
)
def rolling_centred(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(ordered.rolling_centred(e, "value", ["ts", "event_id"], 40, ["event_type"]).select("event_id", "trend"), 9)


@query(
    "W3_trend_line",
    f"""WITH o AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, greatest(20, count(*) OVER (PARTITION BY event_type) // 50) AS w FROM events)
      SELECT a.event_id, {r('avg(b.value)', 8)} AS trend FROM o a JOIN o b ON b.event_type = a.event_type AND b.i BETWEEN a.i - a.w // 2 AND a.i + (a.w - 1) // 2 GROUP BY 1 HAVING count(b.value) >= 5""",
)
def trend_line(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(ordered.trend_line(e, "value", ["ts", "event_id"], ["event_type"]).select("event_id", "trend"), 8)


def ewma_gaps_sql(alpha, back, value):
    """Mean of the present values up to each row, weighted by how many rows ago they were; ``back`` present values reach below double precision."""
    b = f"{1 - alpha}::DOUBLE"
    return f"""WITH e AS (SELECT event_id, event_type, {value} AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
      p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i) AS k FROM e WHERE v IS NOT NULL),
      m AS (SELECT a.event_type, a.i, sum(b.v * pow({b}, a.i - b.i)) / sum(pow({b}, a.i - b.i)) AS s FROM p a JOIN p b
        ON a.event_type = b.event_type AND b.k BETWEEN a.k - {back} AND a.k GROUP BY 1, 2)
      SELECT event_id, {r("s")} AS smoothed FROM e ASOF LEFT JOIN m ON e.event_type = m.event_type AND e.i >= m.i"""


def ewma_sql(alpha, terms, seed=""):
    return f"""WITH o AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
      k AS (SELECT unnest(range({terms})) AS k),
      s AS (SELECT a.event_id, a.i, sum(b.value * pow(1 - {alpha}::DOUBLE, k)) AS num, sum(pow(1 - {alpha}::DOUBLE, k)) AS den
        FROM o a, k JOIN o b ON b.event_type = a.event_type AND b.i = a.i - k GROUP BY 1, 2)
      SELECT event_id, {seed or r('num / den')} AS smoothed FROM s"""


@query("W4_ewma", ewma_sql(0.3, 100))
def ewma(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(ordered.ewma(e, "value", ["ts", "event_id"], 0.3, ["event_type"]).select("event_id", "smoothed"))


@query("W5_ewma_warm_start", ewma_sql(0.4, 70, r("(num + 5.0 * pow(0.6::DOUBLE, i + 1)) / (den + pow(0.6::DOUBLE, i + 1))")))
def ewma_warm_start(t):
    e = t.events.select("event_type", "ts", "event_id", "value").withColumn("last_state", F.lit(5.0))
    out = ordered.ewma(e, "value", ["ts", "event_id"], 0.4, ["event_type"], seed="last_state")
    return rounded(out.select("event_id", "smoothed"))


@query(
    "W6_time_incidence",
    """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total,
      count(*) FILTER (value < 10) AS low, round(count(*) FILTER (value < 10) * 100.0::DOUBLE / count(*), 2) AS rate_pct FROM events GROUP BY 1, 2""",
)
def time_incidence(t):
    out = incidence.incidence(t.events, "ts", F.col("value") < 10, ["event_type"])
    return out.withColumn("window_start", text_time("window_start"))


@query(
    "W6_time_incidence_short_span",
    """WITH e AS (SELECT (ts - INTERVAL 1 DAY * date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE))::TIMESTAMP AS ts, value FROM events)
      SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total,
      count(*) FILTER (value < 10) AS low, round(count(*) FILTER (value < 10) * 100.0::DOUBLE / count(*), 2) AS rate_pct FROM e GROUP BY 1""",
)
def time_incidence_short_span(t):
    # All events folded onto the first day, so the span is below two days and the finer window applies.
    day = F.lit(incidence.DAY)
    e = t.events.withColumn("_m", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.agg((F.floor(F.min("_m") / day) * day).alias("_day"))
    folded = attach(e, first).select("value", F.timestamp_micros((F.col("_day") + F.pmod("_m", day)).cast("long")).alias("ts"))
    return incidence.incidence(folded, "ts", F.col("value") < 10).withColumn("window_start", text_time("window_start"))


@query(
    "W7_autocorrelation",
    f"""WITH o AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS x,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
      v AS (SELECT event_type, sum(x * x) AS ss FROM o GROUP BY 1)
      SELECT a.event_type, k::INTEGER AS lag, {r('sum(a.x * b.x) / any_value(ss)')} AS acf
      FROM o a, range(1, 11) AS ks(k) JOIN o b ON b.event_type = a.event_type AND b.i = a.i - k JOIN v ON v.event_type = a.event_type GROUP BY 1, 2""",
)
def autocorrelation(t):
    from truegauge.operators.diagnostics import autocorrelation as acf

    return rounded(acf(t.events.select("event_type", "ts", "event_id", "value"), "value", ["ts", "event_id"], 10, ["event_type"]))


@query(
    "W8_average_ranks",
    f"""SELECT event_id, {r('rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0')} AS rank FROM events""",
)
def average_ranks(t):
    ranks = quantiles.average_ranks(t.events, "value", ["event_type"])
    return rounded(t.events.join(ranks, ["event_type", "value"]).select("event_id", "rank"))


@query(
    "W9_forward_fill",
    """SELECT event_id, coalesce(last_value(CASE WHEN value > 10 THEN value END IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1.0::DOUBLE) AS filled FROM events""",
)
def forward_fill(t):
    e = t.events.select("user_id", "ts", "event_id", F.when(F.col("value") > 10, F.col("value")).alias("filled"))
    out = ordered.forward_fill(e, ["ts", "event_id"], ["filled"], ["user_id"])
    return out.select("event_id", F.coalesce("filled", F.lit(-1.0)).alias("filled"))


@query(
    "W10_thinning",
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
      g AS (SELECT DISTINCT (j * (SELECT count(*) - 1 FROM events) // 99)::BIGINT AS i FROM range(100) AS g(j))
      SELECT event_id FROM o WHERE i IN (SELECT i FROM g)""",
)
def thinning(t):
    return shaping.thin(t.events.select("ts", "event_id"), ["ts", "event_id"], 100).select("event_id")


@query(
    "M1_ordered_holdout",
    f"""WITH {PAIRS_CTE}, o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) - 1 AS i,
        count(*) OVER (PARTITION BY grp) AS n FROM pairs)
      SELECT o_orderkey, CASE WHEN i < n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM o""",
)
def ordered_holdout(t):
    return splits.ordered_holdout(t.pairs, ["o_orderdate", "o_orderkey"], 0.2, ["grp"]).select("o_orderkey", "role")


@query("M2_random_holdout")
def random_holdout(t):
    return splits.random_holdout(t.orders, "o_orderkey", 0.2, 42).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M3_expanding_windows",
    f"""WITH {PAIRS_CTE}, o AS (SELECT o_orderkey, grp, row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) - 1 AS i,
        count(*) OVER (PARTITION BY grp) AS n FROM pairs),
      w AS (SELECT *, floor(n * 0.7::DOUBLE)::BIGINT AS init, greatest((n - floor(n * 0.7::DOUBLE)::BIGINT) // 3, 1) AS step FROM o),
      x AS (SELECT *, k AS win, CASE WHEN k = 2 THEN n - greatest(floor(n * 0.15::DOUBLE)::BIGINT, 20) ELSE init + k * step END AS train_end FROM w, range(3) AS ks(k)),
      y AS (SELECT *, CASE WHEN win = 2 THEN n ELSE least(train_end + step, n) END AS test_end FROM x)
      SELECT grp, (win + 1)::INTEGER AS fold, CASE WHEN i < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS rows, min(o_orderkey) AS first_key
      FROM y WHERE i < test_end AND train_end < test_end AND train_end >= 30 AND n >= 50 GROUP BY 1, 2, 3""",
)
def expanding_windows(t):
    out = splits.expanding_windows(t.pairs, ["o_orderdate", "o_orderkey"], ["grp"])
    return out.groupBy("grp", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


@query("W4_ewma_null_runs", ewma_gaps_sql(0.7, 40, "CASE WHEN event_id % 997 < 400 THEN value END"))
def ewma_null_runs(t):
    rows = t.events.select("event_id", "ts", "event_type", F.when(F.col("event_id") % 997 < 400, F.col("value")).alias("value"))
    return rounded(ordered.ewma(rows, "value", ["ts", "event_id"], 0.7, ["event_type"]).select("event_id", "smoothed"))
