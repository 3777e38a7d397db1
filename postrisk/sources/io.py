"""Scans and sinks.

All sinks go through Spark's output commit protocol, which replaces the
write-temp-then-rename dance of a single-machine script.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postrisk.constants import DEFAULT_THRESHOLD

RAW_POST_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("collection_type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("likes", T.StringType()),
    T.StructField("reposts", T.StringType()),
    T.StructField("replies", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("author_username", T.StringType()),
    T.StructField("scraped_at_utc", T.StringType()),
])


def read_posts(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType = RAW_POST_SCHEMA) -> DataFrame:
    """Post table with a declared schema (``post_id`` always a string)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = (r.option("header", True).option("multiLine", True).option("escape", '"')
             .option("mode", "PERMISSIVE"))
    return r.format(fmt).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_sources(spark: SparkSession, sources: Sequence[tuple[str, str]], fmt: str = "csv",
                 schema: T.StructType = RAW_POST_SCHEMA) -> DataFrame:
    """Union the sources that exist, in order, tagged with ``source_rank``;
    fail only when none exists."""
    frames = []
    for rank, (name, path) in enumerate(sources):
        if _exists(spark, path):
            frames.append(read_posts(spark, path, fmt, schema)
                          .withColumn("source_rank", F.lit(rank))
                          .withColumn("source_name", F.lit(name)))
    if not frames:
        raise FileNotFoundError(f"none of the sources exists: {[p for _, p in sources]}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def resolve_source(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
                   aliases: dict[str, str] | None = None, columns=("post_id", "text")) -> DataFrame:
    """S3: first existing source that has the wanted columns, after renaming aliases
    (e.g. ``text_clean`` -> ``text``)."""
    aliases = aliases or {"text_clean": "text"}
    for path in paths:
        if not _exists(spark, path):
            continue
        df = spark.read.format(fmt).option("header", True).load(path)
        for old, new in aliases.items():
            if new not in df.columns and old in df.columns:
                df = df.withColumnRenamed(old, new)
        if all(c in df.columns for c in columns):
            return df.select(*columns)
    raise FileNotFoundError(f"no source with columns {columns} among {list(paths)}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] | None = None) -> str:
    """Overwrite, ignore (create-if-absent) or append. A job must not
    overwrite a table it reads; write a new versioned path instead."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # RFC 4180 quoting (quotes doubled) and values kept byte for byte, so the
        # multi-line reader of ``read_posts`` gets back exactly what was written
        w = (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One table partitioned by ``split``; readers prune to the split they need."""
    return write_table(df, path, mode=mode, partition_by=["split"])


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Small report tables (threshold, weights, metrics, model comparison)."""
    return write_table(df.coalesce(1), path, mode=mode, fmt=fmt)


def read_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> float:
    """The chosen threshold, or the default when no report exists."""
    if not _exists(spark, path):
        return float(default)
    rows = (spark.read.schema("chosen_threshold double").json(path)
            .filter(F.col("chosen_threshold").isNotNull()).limit(1).collect())
    return float(rows[0][0]) if rows else float(default)


def save_model(model, path: str) -> str:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a fitted pipeline."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
