"""Sinks: one dataset per report table, an appended run log, model artefacts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.operators.boosting import BoostedTrees


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every named table under ``root``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", "true").save(paths[name])
    return paths


def run_log(metrics: DataFrame, ids: list[str], run_ts: str, source: str) -> DataFrame:
    """Long form ``(run_ts, ids..., source, metric, value)`` of a wide metric table."""
    values = [c for c in metrics.columns if c not in ids]
    long = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, "metric", "value")
    return long.select(F.lit(run_ts).alias("run_ts"), *ids, F.lit(source).alias("source"), "metric", "value")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("run_ts").parquet(path)


# --- versioned model artefacts ---------------------------------------------------------------------------


@dataclass
class Artefact:
    """All that scoring needs: a fitted model, category frequencies, the last smoothed value per group, and ``facts`` (roles and parameters, plain JSON)."""

    model: PipelineModel | BoostedTrees
    frequencies: DataFrame
    state: DataFrame
    facts: dict
    version: int = 0
    places: dict = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions below ``path``, oldest first."""
    fs, place = _file_system(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Make a version visible: its manifest is written under another name and moved in one step. A version that another writer committed meanwhile is an error."""
    fs, place = _file_system(spark, f"{path}/manifest-{version:08d}.json")
    _, draft = _file_system(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        raise FileExistsError(f"version {version} of {path} was committed by another writer")


def save_artefact(path: str, artefact: Artefact) -> int:
    """Write a new version and commit it last. Parts go to folders of their own, so nothing that an earlier version names is touched, and a
    write that fails leaves the last version as it was. Returns the version's number."""
    spark = artefact.state.sparkSession
    at = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
    places = {"frequencies": f"{at}/frequencies", "state": f"{at}/state"}
    if isinstance(artefact.model, BoostedTrees):
        m = artefact.model
        places |= {"base": f"{at}/base", "trees": f"{at}/trees" if m.trees is not None else None}
        m.base.write.parquet(places["base"])
        if m.trees is not None:
            m.trees.write.parquet(places["trees"])
        model = {"kind": "boosted", "features": m.features, "by": m.by, "depth": m.depth}
    else:
        places["pipeline"] = f"{at}/pipeline"
        artefact.model.write().save(places["pipeline"])
        model = {"kind": "pipeline"}
    artefact.frequencies.write.parquet(places["frequencies"])
    artefact.state.write.parquet(places["state"])
    version = max(versions(spark, path), default=0) + 1
    _commit(spark, path, version, {"version": version, "model": model, "places": places, "facts": artefact.facts})
    return version


def save_state(path: str, artefact: Artefact, state: DataFrame) -> int:
    """Commit a version that differs from the loaded ``artefact`` in its state alone; the model's files are shared."""
    spark = state.sparkSession
    place = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}/state"
    state.write.parquet(place)
    manifest = _manifest(spark, path, artefact.version)
    manifest["places"]["state"] = place
    manifest["version"] = artefact.version + 1
    _commit(spark, path, artefact.version + 1, manifest)
    return artefact.version + 1


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    rows = spark.read.text(f"{path.rstrip('/')}/manifest-{version:08d}.json", wholetext=True)
    return json.loads(rows.first()[0])


def load_artefact(spark: SparkSession, path: str, version: int | None = None) -> Artefact:
    """The given version, or the last committed one. Files that no manifest names are never read."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a model in {path}")
    version = known[-1] if version is None else version
    manifest = _manifest(spark, path, version)
    places, model = manifest["places"], manifest["model"]
    if model["kind"] == "boosted":
        trees = spark.read.parquet(places["trees"]) if places["trees"] else None
        fitted = BoostedTrees(model["features"], model["by"], spark.read.parquet(places["base"]), trees, model["depth"])
    else:
        fitted = PipelineModel.load(places["pipeline"])
    return Artefact(fitted, spark.read.parquet(places["frequencies"]), spark.read.parquet(places["state"]), manifest["facts"], version, places)
