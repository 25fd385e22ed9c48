"""Streaming operators (T). Input folders fill up in time order, as arriving batches would."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.catalog.cleaning import FLAGGED_CTE, REQUIRED, RULE_SQL, RULES
from truegauge.catalog.ingest import scratch
from truegauge.catalog.modelling import FEATURES, QUICK, pair_rows
from truegauge.catalog.ordering import ewma_gaps_sql, ewma_sql
from truegauge.catalog.registry import COIL_SPEC, DERIVED_CTE, query, rounded, text_time
from truegauge.operators import features, models, quality
from truegauge.operators.lookup import attach
from truegauge.session import materialise
from truegauge.streaming import queries as streams
from truegauge.streaming.keyed import keyed_smoothing

ARRIVALS = 3


def arrive(df, time, path, step):
    """Append the rows to ``path`` in ``ARRIVALS`` slices of equal time span, calling ``step`` after each."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = df.agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    share = (micros - F.col("_lo")) * ARRIVALS / (F.col("_hi") - F.col("_lo") + 1)
    sliced = attach(df, span).withColumn("_slice", F.floor(share)).drop("_lo", "_hi")
    for i in range(ARRIVALS):
        sliced.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
        step()


EVENTS = ("event_id", "ts", "event_type", "value")


def smoothed_stream(t, events, alpha):
    src, out, state, chk = (scratch(t, n) for n in ("in", "out", "state", "chk"))
    handler = streams.smoothing_batches("value", ["ts", "event_id"], ["event_type"], alpha, out, state)
    arrive(events, "ts", src, lambda: streams.run_batches(streams.file_stream(t.spark, src, events.schema), handler, chk))
    return rounded(t.spark.read.parquet(out).select("event_id", "smoothed"))


@query("T1_stateful_ewma", ewma_sql(0.3, 100))
def stateful_ewma(t):
    """Exact continuation over micro-batches by the keyed state operator; every micro-batch is a restart from the checkpoint."""
    src, out, chk = (scratch(t, n) for n in ("in", "out", "chk"))
    events = t.events.select(*EVENTS)

    def step():
        stream = streams.file_stream(t.spark, src, events.schema)
        streams.run_available(keyed_smoothing(stream, "value", "ts", ["ts", "event_id"], ["event_type"], 0.3, sub_seconds=6 * 3600), out, chk)

    arrive(events, "ts", src, step)
    return rounded(t.spark.read.parquet(out).select("event_id", "smoothed"))


GAPS = "CASE WHEN event_id % 997 < 400 THEN value END"


@query("T1_null_runs", ewma_gaps_sql(0.7, 40, GAPS))
def null_runs(t):
    """Gaps longer than the memory of the mean, across micro-batches: the last mean stays."""
    return smoothed_stream(t, t.events.select("event_id", "ts", "event_type", F.expr(GAPS).alias("value")), 0.7)


@query("T1_batch_state_ewma", ewma_sql(0.3, 100))
def batch_state_ewma(t):
    """State table: the same result with the parallel operator, whatever one group's share."""
    src, out, state, chk = (scratch(t, n) for n in ("in", "out", "state", "chk"))
    events = t.events.select(*EVENTS)
    handler = streams.smoothing_batches("value", ["ts", "event_id"], ["event_type"], 0.3, out, state)
    arrive(events, "ts", src, lambda: streams.run_batches(streams.file_stream(t.spark, src, events.schema), handler, chk))
    return rounded(t.spark.read.parquet(out).select("event_id", "smoothed"))


@query(
    "T2_incidence_stream",
    """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total, count(*) FILTER (value < 10) AS low,
      round(count(*) FILTER (value < 10) * 100.0::DOUBLE / count(*), 2) AS rate_pct FROM events GROUP BY 1, date_trunc('day', ts)
      HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def incidence_stream(t):
    src, out, chk = scratch(t, "in"), scratch(t, "out"), scratch(t, "chk")
    events = t.events.select(*EVENTS)

    def step():
        stream = streams.file_stream(t.spark, src, events.schema)
        streams.run_available(streams.incidence_stream(stream, "ts", F.col("value") < 10, by=["event_type"]), out, chk)

    arrive(events, "ts", src, step)
    return t.spark.read.parquet(out).withColumn("window_start", text_time("window_start"))


@query("T3_stream_scoring")
def stream_scoring(t):
    src, out, state, chk = (scratch(t, n) for n in ("in", "out", "state", "chk"))
    rows = pair_rows(t)
    model = models.ResidualCorrection(FEATURES, "delta", QUICK).fit(rows.where("role = 'train'"))
    new = rows.where("role = 'test'").select("o_orderkey", "o_orderdate", "o_orderstatus", *FEATURES)
    handler = streams.scoring_batches(model, "online", ["o_orderdate", "o_orderkey"], ["o_orderstatus"], 0.7, out, state)
    arrive(new, "o_orderdate", src, lambda: streams.run_batches(streams.file_stream(t.spark, src, new.schema), handler, chk))
    scored = t.spark.read.parquet(out)
    return scored.select("o_orderkey", "online", "smoothed", (F.col("online") + F.col("smoothed")).alias("corrected"))


STREAM_REASON = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_SQL.items()) + ")"


@query("T4_stream_flags", f"WITH {DERIVED_CTE} SELECT coil_id, {STREAM_REASON} AS filter_reason FROM derived")
def stream_flags(t):
    src, out, chk = scratch(t, "in"), scratch(t, "out"), scratch(t, "chk")
    coils = materialise(t.coils, "coils")

    def step():
        stream = features.derive(streams.file_stream(t.spark, src, coils.schema), COIL_SPEC)
        flagged = streams.flag_stream(stream, quality.row_rules(COIL_SPEC, RULES, REQUIRED))
        streams.run_available(flagged.select("coil_id", "filter_reason"), out, chk)

    arrive(coils, "produce_time", src, step)
    return t.spark.read.parquet(out)


@query("T4_stream_flags_with_limits", f"WITH {FLAGGED_CTE} SELECT coil_id, filter_reason FROM flagged")
def stream_flags_with_limits(t):
    """Limits measured on history flag stream rows in the words of the batch cleaning."""
    src, out, chk = scratch(t, "in"), scratch(t, "out"), scratch(t, "chk")
    coils, rules = materialise(t.coils, "coils"), quality.row_rules(COIL_SPEC, RULES, REQUIRED)
    good = features.derive(coils, COIL_SPEC).where(quality.reasons(rules) == "")
    parts = [
        quality.mad_limits(good, c, RULES).select(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(c).alias("column"), "centre", "limit")
        for i, (n, c) in enumerate((("Top", "top_delta"), ("Bot", "bot_delta")))
    ]
    # Files are read largest first, and reasons are named in the order of the limits.
    limits = materialise(parts[0].unionByName(parts[1]), "limits").orderBy("place")

    def step():
        stream = features.derive(streams.file_stream(t.spark, src, coils.schema), COIL_SPEC)
        streams.run_available(streams.flag_stream(stream, rules, limits).select("coil_id", "filter_reason"), out, chk)

    arrive(coils, "produce_time", src, step)
    return t.spark.read.parquet(out)
