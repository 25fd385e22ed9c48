"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Row groups and pages of scratch tables, in bytes. With the usual ones every page and column is a large object to the executors' heap, which
#: then grows to its limit however little of it is in use.
SCRATCH = {"parquet.block.size": 16 << 20, "parquet.page.size": 128 << 10, "parquet.dictionary.page.size": 128 << 10}
#: Bytes that a reader of Parquet files takes at once.
READ_BYTES = 256 << 10

#: Scratch folders of local applications that named none, by application id.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` wins. Only a local master, where driver and executors are one
    process, may fall back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="truegauge-")
    return _FOLDERS[app]


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on: adaptive execution, and splitting of skewed join
    partitions even where that costs one more shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own size estimate lets ``df`` be broadcast. Runs no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used where two passes must see the *same* physical layout (range bounds are sampled, so
    re-planning the shuffle could move rows) and where iteration would grow the lineage. The
    table survives executor loss, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/truegauge/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.options(**SCRATCH).parquet(path)
    return spark.read.schema(df.schema).option("parquet.read.allocation.size", READ_BYTES).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and that nothing reads any more."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables this application wrote."""
    root = f"{shared_dir(spark)}/truegauge/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
