"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "postrisk",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    On a cluster pass ``master=None`` and let the launcher decide; the
    partition count should then be sized to the data (about 128-256 MB of
    shuffle data per partition), AQE coalesces the rest at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where nothing is configured a private folder is created for a local master;
    on a cluster that would be each machine's own disk, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="postrisk-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for tables a job writes and re-reads;
    ``release`` deletes it."""
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    MATERIALIZED.append(path)
    return path


def materialize(df: DataFrame, name: str = "materialized", options: dict | None = None) -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared checkpoint folder
    and reading it back. ``options`` are the writer's.

    Used before a table is read several times (fit + apply of global
    statistics, counts, vocabularies) so an expensive upstream runs once; the
    table lives on shared storage, so losing an executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


TASK_CHARS = 8_000_000


def by_key(df: DataFrame, key: str, text_col: str, task_chars: int | None = None) -> DataFrame:
    """``df`` dealt by key into as many tasks as its texts fill at ``task_chars`` each
    (``TASK_CHARS`` by default).

    What is grouped by key and word next needs no further exchange, and a task's share of it
    doesn't grow with the table (nor with how well its files are packed). ``df`` is a stored table: it is
    read once for its length."""
    chars = df.agg(F.sum(F.length(text_col) + 1)).first()[0] or 0
    return df.repartition(max(1, -(-chars // (task_chars or TASK_CHARS))), key)


MATERIALIZED: list[str] = []


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch folders (all of this process's by default) once no plan
    reads them any more."""
    todo = list(MATERIALIZED) if paths is None else list(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in todo:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
        if p in MATERIALIZED:
            MATERIALIZED.remove(p)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a folder. Tasks follow the file splits; see
    ``spark.sql.files.maxPartitionBytes`` and the row-group size of the writer."""
    return spark.read.parquet(table_path(sf_dir, name))
