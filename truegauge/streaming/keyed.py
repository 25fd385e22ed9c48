"""Smoothing as a keyed state operator: the engine keeps each group's state, expires it by event time, and restores it from its checkpoint.

A group's rows of a micro-batch are first worked on in sub-series of consecutive times, each a key of its own, so a hot group spreads over tasks. What a
sub-series does to the mean is three numbers, (mean, weight, rows), and two of them in a row combine to one. The
operator that holds the state sees one row per sub-series, folds these numbers in order and hands each its start; the rows' values follow from
the start without any state.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

# Helper columns start with "sub": the engine renames columns that start with an underscore on their way to Python.

#: What the engine needs for such operators (fixed name).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combine(mean: float | None, weight: float, then_mean: float | None, then_weight: float, fade: float) -> tuple[float | None, float]:
    """Mean and weight of a series followed by another one, at whose end the first one's weight has shrunk by ``fade``.

    Without values of the second one (or of both within the range of doubles) the last mean stays."""
    old = weight * fade
    total = old + then_weight
    if then_mean is None or not then_weight:
        return (mean if mean is not None else then_mean), old
    if mean is None or not old:
        return then_mean, then_weight
    return (mean * old + then_mean * then_weight) / total, total


class SubSeries(StatefulProcessor):
    """Means and weights along one sub-series of a micro-batch, as if it were the first: one row with all its rows in order."""

    def __init__(self, by: list[str], columns: list[str], order: list[str], value: str, time: str, keep: float):
        self.by, self.columns, self.order, self.value, self.time, self.keep = by, columns, order, value, time, keep

    def init(self, handle) -> None:
        pass

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        mean, weight, means, weights = None, 0.0, [], []
        for x in pdf[self.value].tolist():
            weight *= self.keep
            if x is not None and x == x:
                weight += 1.0
                mean = x if mean is None else mean + (x - mean) / weight
            means.append(mean)
            weights.append(weight)
        listed = [dict(zip(self.columns, r)) | {"sub_mean": m, "sub_weight": w} for r, m, w in zip(_plain(pdf[self.columns]), means, weights)]
        out = {c: [k] for c, k in zip([*self.by, "sub_no"], key)}
        yield pd.DataFrame(out | {"sub_time": [pdf[self.time].max()], "sub_mean": [mean], "sub_weight": [weight], "sub_rows": [listed]})


def _plain(pdf: pd.DataFrame):
    """Rows with None for missing values."""
    return pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)


class Fold(StatefulProcessor):
    """Hands every sub-series of a group what came before it, and keeps what comes after. Forgets a group that brings nothing for ``ttl`` of event time."""

    def __init__(self, by: list[str], keep: float, ttl_ms: int | None):
        self.by, self.keep, self.ttl = by, keep, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("smoothed", "mean double, weight double")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((_number(initialState["sub_mean"].iloc[0]), float(initialState["sub_weight"].iloc[0])))

    def handleInputRows(self, key, rows, timerValues):
        parts = pd.concat(list(rows)).sort_values("sub_no", kind="stable")
        mean, weight = self.state.get() if self.state.exists() else (None, 0.0)
        starts = []
        for m, w, listed in zip(parts["sub_mean"].tolist(), parts["sub_weight"].tolist(), parts["sub_rows"]):
            starts.append((mean, weight))
            mean, weight = combine(_number(mean), weight, _number(m), w, self.keep ** len(listed))
        self.state.update((mean, weight))
        if self.ttl is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(pd.Timestamp(parts["sub_time"].max()).timestamp() * 1000) + self.ttl)
        yield pd.DataFrame({"sub_rows": list(parts["sub_rows"]), "sub_start": [m for m, _ in starts], "sub_start_weight": [w for _, w in starts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield from ()


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def keyed_smoothing(
    stream: DataFrame, value: str, time: str, order: Sequence[str], by: Sequence[str], alpha: float, sub_seconds: int = 3600, lateness: str = "0 seconds",
    ttl_seconds: int | None = None, initial: DataFrame | None = None,
) -> DataFrame:
    """``stream`` with ``smoothed``, the adjusted exponentially weighted mean of its group so far (NULL is a group too).

    Micro-batches are taken in the order they come, rows of one by ``order``; its first entry has to grow with ``time``. NULL values take the mean before them. ``sub_seconds``
    is the time a sub-series spans: its rows of one micro-batch are the most that a task computes on at once. Columns must not start with an underscore. ``initial`` (``by`` columns,
    ``sub_mean``, ``sub_weight``) is where groups start from. After ``ttl_seconds`` of event time without rows a group starts anew.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    by, columns, keep = list(by), stream.columns, 1.0 - alpha
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.withColumn("sub_time", F.col(time).cast("timestamp")).withWatermark("sub_time", lateness).withColumn("sub_no", F.floor(F.unix_seconds("sub_time") / sub_seconds))
    fields = {f.name: f for f in stream.schema.fields}
    row = T.StructType([*[T.StructField(c, fields[c].dataType) for c in columns], T.StructField("sub_mean", T.DoubleType()), T.StructField("sub_weight", T.DoubleType())])
    packed = T.StructType(
        [
            *[T.StructField(c, fields[c].dataType) for c in by], T.StructField("sub_no", T.LongType()), T.StructField("sub_time", T.TimestampType()),
            T.StructField("sub_mean", T.DoubleType()), T.StructField("sub_weight", T.DoubleType()), T.StructField("sub_rows", T.ArrayType(row)),
        ]
    )
    subs = rows.groupBy(*by, "sub_no").transformWithStateInPandas(SubSeries(by, columns, list(order), value, time, keep), packed, "Append", "EventTime", eventTimeColumnName="sub_time")
    started = T.StructType([T.StructField("sub_rows", T.ArrayType(row)), T.StructField("sub_start", T.DoubleType()), T.StructField("sub_start_weight", T.DoubleType())])
    fold = Fold(by, keep, None if ttl_seconds is None else ttl_seconds * 1000)
    first = initial.groupBy(*by) if initial is not None else None
    done = subs.groupBy(*by).transformWithStateInPandas(fold, started, "Append", "EventTime", initialState=first)
    each = done.select("sub_start", "sub_start_weight", F.posexplode("sub_rows").alias("sub_at", "sub_row"))
    old = F.coalesce("sub_start_weight", F.lit(0.0)) * F.pow(F.lit(keep), F.col("sub_at") + 1)
    own = F.col("sub_row.sub_weight")
    mean = F.when(F.col("sub_row.sub_mean").isNull() | (own == 0), F.coalesce("sub_start", "sub_row.sub_mean")).when(F.col("sub_start").isNull() | (old == 0), F.col("sub_row.sub_mean"))
    mean = mean.otherwise((F.col("sub_start") * old + F.col("sub_row.sub_mean") * own) / (old + own))
    return each.select(*[F.col("sub_row")[c].alias(c) for c in columns], mean.alias("smoothed"))
