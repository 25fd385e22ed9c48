"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of ``links`` (a, b); label is the smallest id of the component.

    Each round points neighbours at the smallest one they know of; rounds go on until nothing moves. Round tables are written to the shared
    folder, so lineage stays short. Minima are combined before the shuffle; a node with many links is a skewed join that Spark may split.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        edges = materialise(small.distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label").unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
