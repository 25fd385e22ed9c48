"""Streaming twins: incidence with watermark, rule flags, smoothing with state, scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.incidence import rate_columns
from truegauge.operators.ordered import ewma
from truegauge.operators.quality import reasons
from truegauge.operators.lookup import absent, attach
from truegauge.session import materialise

def file_stream(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, append it to a table and stop; the checkpoint remembers the rest."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# --- tumbling incidence --------------------------------------------------------------------------


def incidence_stream(events: DataFrame, ts: str, low: Column, width: str = "1 day", delay: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Share of low readings per tumbling window. A window is emitted once the watermark passes its end;
    rows later than ``delay`` behind the newest time are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (
        timed.groupBy(*by, F.window("_ts", width).alias("_w"))
        .agg(*rate_columns(low))
        .select(*by, F.col("_w.start").alias("window_start"), "total", "low", "rate_pct")
    )


# --- rule flags ------------------------------------------------------------------------------------


def flag_stream(rows: DataFrame, rules: dict[str, Column], limits: DataFrame | None = None) -> DataFrame:
    """Row rules on a stream. Residual limits measured on history may be joined in:
    ``limits(name, column, centre, limit)`` with one row per surface and its delta column."""
    flagged = rows.withColumn("filter_reason", reasons(rules))
    if limits is None:
        return flagged
    # Only rows that pass all rules are held against the limits, and a row beyond several of them names each.
    far = {}
    for r in limits.collect():  # one row per surface
        c = r["column"]
        far[f"{r['name']} residual outlier"] = F.coalesce(F.abs(F.col(c) - F.lit(r["centre"])) > F.lit(r["limit"]), F.lit(False))
    return flagged.withColumn("filter_reason", F.when(F.col("filter_reason") == "", reasons(far)).otherwise(F.col("filter_reason")))


# --- smoothing with a state table, no group in one task ------------------------------------------------------


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def smoothing_batches(
    value: str, order: Sequence[str], by: Sequence[str], alpha: float, out: str, state: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
    restart: bool = False,
) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``: smooth a micro-batch of any size with the parallel batch operator.

    The state after batch k is a small table under ``<state>/batch=k``; batch k reads that of k-1 and
    overwrites its own output and state, so a repeated batch gives the same result.
    """
    by = list(by)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        before = _read_if_there(batch.sparkSession, f"{state}/batch={batch_id - 1}")
        if before is None and batch_id > 0:
            raise FileNotFoundError(f"state of batch {batch_id - 1} is missing in {state}: smoothing can't go on from it")
        seeds = {}
        if before is not None:
            rows = attach(rows, before, by)
            seeds = {"seed": "_last", "seed_weight": None if restart else "_mass"}
        smooth = materialise(ewma(rows, value, order, alpha, by, "smoothed", weight_out="_den", **seeds), "micro-batch")
        rank = F.struct(*order)
        after = smooth.groupBy(*by).agg(F.max_by("smoothed", rank).alias("_last"), F.max_by("_den", rank).alias("_mass"))
        if before is not None:  # groups absent from this batch keep their state
            after = after.unionByName(absent(before, after, by))
        after.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        smooth.drop("_last", "_mass", "_den").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scoring_batches(model, online: str, order: Sequence[str], by: Sequence[str], alpha: float, out: str, state: str):
    """Score with a fitted model and smooth across micro-batches: ``corrected`` per row."""

    def prepare(batch: DataFrame) -> DataFrame:
        return model.transform(batch)

    return smoothing_batches("predicted_delta", order, by, alpha, out, state, prepare)
