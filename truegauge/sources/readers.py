"""Sources: multi-file union scans, laboratory CSV, header handling, parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.ordered import forward_fill, with_ordinal
from truegauge.operators.lookup import attach
from truegauge.spec import ModelParams


def union_scan(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, fmt: str = "parquet", schema=None, **options
) -> DataFrame:
    """Read many files with one projection, tag each row with its file; duplicates are kept."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(list(paths))
    picked = df.select(*columns) if columns else df
    return picked.select("*", F.col("_metadata.file_name").alias("source_file"))


def master_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is empty (a distributed scan has no "first" blank row to stop at)."""
    return df.na.drop("all")


def allow_java_charsets(spark: SparkSession) -> None:
    """Text encodings beyond the Unicode and Latin-1 families need this switch."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def lab_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "utf-8", fallback: str = "gbk") -> DataFrame:
    """CSV with a declared schema. A file that can't be read in ``encoding`` anywhere is read in ``fallback``, each file by itself.

    One pass over all lines finds the files with a malformed character; only their names come to the driver.
    """
    allow_java_charsets(spark)
    read = lambda paths, code: spark.read.csv(paths, schema=schema, header=True, encoding=code, enforceSchema=True)
    lines = spark.read.schema("line string").option("encoding", encoding).option("sep", "\x01").option("quote", "\x02").csv(path)
    lines = lines.select("line", F.col("_metadata.file_path").alias("file"))
    bad = {r["file"] for r in lines.where(F.col("line").contains("\ufffd")).select("file").distinct().collect()}
    if not bad:
        return read(path, encoding)
    good = [r["file"] for r in lines.select("file").distinct().collect() if r["file"] not in bad]
    other = read(sorted(bad), fallback)
    return read(sorted(good), encoding).unionByName(other) if good else other


def offset_header_csv(spark: SparkSession, path: str, names: Sequence[str], skip: int, **options) -> DataFrame:
    """All-text CSV whose names sit ``skip`` lines below the top of each file; names are stripped.

    Lines are told by their place, never by what they hold: everything up to the header line goes, all behind it stays but for empty
    lines. The place of a line is its block's offset in the file and the line's number in that block, so files may be split.
    """
    clean = [n.strip() for n in names]
    lines = spark.read.option("wholetext", "false").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    # The first lines of a file are the first ones of its first block; ``skip`` and the header itself are few.
    top = lines.where("_block = 0").groupBy("_file").agg(F.min("_line").alias("_top"))
    body = lines.join(top, "_file").where((F.col("_block") > 0) | (F.col("_line") > F.col("_top") + skip)).where(F.length(F.trim("value")) > 0)
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    return body.select(F.from_csv("value", F.lit(schema), {k: str(v) for k, v in options.items()}).alias("r")).select("r.*").toDF(*clean)


def patch_names(df: DataFrame, patch: dict[str, str]) -> DataFrame:
    """Rename the wrong names that are present; the others are ignored."""
    return df.withColumnsRenamed({k: v for k, v in patch.items() if k in df.columns})


def flatten_header(header: DataFrame, column: str = "col_idx", levels: Sequence[str] = ("h1", "h2", "h3"), fill: Sequence[str] = ("h1", "h2")) -> DataFrame:
    """Column names from a header table with merged cells.

    Empty upper cells take the text to their left, repeated neighbours collapse, parts join with
    ``_`` and later duplicates are numbered ``_1``, ``_2``, ...
    """
    blank = header.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in levels})
    filled = forward_fill(blank, [column], list(fill))
    parts = [F.col(levels[0])]
    for above, c in zip(levels, levels[1:]):
        parts.append(F.when(~F.col(c).eqNullSafe(F.col(above)), F.col(c)))
    named = filled.select(column, F.concat_ws("_", *parts).alias("base"))
    # A name may repeat without bound, so its occurrences are numbered by the ordered carry, not in one window.

    numbered = with_ordinal(named, [column], ["base"], "_seen")
    return numbered.select(
        column,
        F.when(F.col("_seen") == 0, F.col("base"))
        .otherwise(F.concat_ws("_", F.col("base"), F.col("_seen").cast("string")))
        .alias("name"),
    )


PARAM_FIELDS = tuple(ModelParams.__dataclass_fields__)
_PARAM_STRUCT = T.StructType(
    [T.StructField(f, T.IntegerType() if f in ("max_iter", "max_depth") else T.DoubleType()) for f in PARAM_FIELDS]
)
GROUP_PARAMS_SCHEMA = T.StructType(
    [
        T.StructField("target_groups", T.ArrayType(T.StringType())),
        T.StructField("min_group_samples", T.IntegerType()),
        T.StructField("default_params", _PARAM_STRUCT),
        T.StructField("group_params_override", T.MapType(T.StringType(), _PARAM_STRUCT)),
    ]
)


def group_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read the parameter document: (one-row defaults, overrides keyed by ``group__surface``)."""
    doc = spark.read.schema(GROUP_PARAMS_SCHEMA).json(path, multiLine=True)
    defaults = doc.select("target_groups", "min_group_samples", "default_params.*")
    overrides = doc.select(F.explode("group_params_override").alias("tag", "p")).select("tag", "p.*")
    return defaults, overrides


def with_params(groups: DataFrame, defaults: DataFrame, overrides: DataFrame, group: str = "group", surface: str = "surface") -> DataFrame:
    """Parameters of every ``(group, surface)``: the override where given, field by field, else the default."""
    fields = [f for f in PARAM_FIELDS if f in defaults.columns]
    base = attach(groups, defaults.select(*[F.col(f).alias(f"_d_{f}") for f in fields]))
    tagged = base.withColumn("_tag", F.concat_ws("__", group, surface))
    over = overrides.select(F.col("tag").alias("_tag"), *[F.col(f).alias(f"_o_{f}") for f in fields if f in overrides.columns])
    joined = tagged.join(over, "_tag", "left")
    picked = [
        F.coalesce(*[F.col(f"{p}{f}") for p in ("_o_", "_d_") if f"{p}{f}" in joined.columns]).alias(f) for f in fields
    ]
    return joined.select(*groups.columns, *picked)
