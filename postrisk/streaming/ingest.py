"""Incremental ingest as a checkpointed stream with keyed state.

The ids that were ever ingested live in the stream's state store, one key a
(collection, id), dealt out by key. A micro-batch brings all its rows, and beside them the keys that
Spark's own streaming de-duplication lets through: those that no earlier batch had. It looks up and
adds its own keys and never reads the sink. Rows of these keys are new; among them the first
arrival of the batch wins. Rows stored before the stream began enter the state with
the first batch. Quotas and the newest time come from a table of running counts, one
small partition a batch, of which a batch reads the one before it. Writes go to the
batch's own partition with dynamic overwrite, so a batch replayed after a failure replaces
its earlier attempt instead of adding to it; the state of a replayed batch is that of its
first attempt. A batch is persisted while its writes use it, so the state is asked once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postrisk.functions.scores import parse_ts
from postrisk.operators import ingest as ops
from postrisk.operators.cleaning import ARRIVAL, arrival_order
from postrisk.sources.io import _exists

BATCH_COL = "_batch"
STORED_COL = "_stored"
UNSEEN_COL = "_unseen"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _no_key(schema: T.StructType) -> Column:
    """Rows whose (collection, id) has a null or a NaN: their ids are never known."""
    parts = [F.col(c).isNull() for c in ops.COLLECTION_KEY]
    parts += [F.isnan(c) for c in ops.COLLECTION_KEY if isinstance(schema[c].dataType, T.FractionalType) and not isinstance(schema[c].dataType, T.DecimalType)]
    return reduce(lambda x, y: x | y, parts)


def with_unseen(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """A stream's rows, and a row with ``_unseen`` for each (collection, id) that has not come in an earlier batch;
    rows with ``_stored`` mark ids as known. The state holds the keys alone."""
    keys = rows.where(~_no_key(schema)).select(*ops.COLLECTION_KEY).dropDuplicates(list(ops.COLLECTION_KEY))
    return rows.withColumn(UNSEEN_COL, F.lit(False)).unionByName(
        keys.withColumns({STORED_COL: F.lit(False), UNSEEN_COL: F.lit(True)}), allowMissingColumns=True)


def counts_path(sink_path: str) -> str:
    return f"{sink_path.rstrip('/')}_counts"


def _counts_before(spark: SparkSession, sink_path: str, batch_id: int, ts: str | None) -> DataFrame:
    """(collection_type, query, already, newest) before a batch: the running counts of the batch before it,
    or for the first one the rows that the sink was seeded with."""
    path = counts_path(sink_path)
    if batch_id > 0 and _exists(spark, path):
        done = spark.read.parquet(path).where(F.col(BATCH_COL) < batch_id)
        return done.where(F.col(BATCH_COL) == done.agg(F.max(BATCH_COL)).scalar()).drop(BATCH_COL)
    schema = "collection_type string, query string, already long, newest timestamp"
    if not _exists(spark, seed_path(sink_path)):
        return spark.createDataFrame([], schema)
    seed = spark.read.parquet(seed_path(sink_path))
    newest = F.max(parse_ts(ts)) if ts else F.lit(None).cast("timestamp")
    return seed.groupBy("collection_type", "query").agg(F.count(F.lit(1)).alias("already"), newest.alias("newest"))


def seed_path(sink_path: str) -> str:
    return f"{sink_path.rstrip('/')}/{BATCH_COL}=-1"


def _write(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn(BATCH_COL, F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH_COL).parquet(path))


def late_path(sink_path: str) -> str:
    return f"{sink_path.rstrip('/')}_late"


def seed_sink(df: DataFrame, sink_path: str) -> None:
    """Store rows collected before the stream started (as batch -1)."""
    df.withColumn(BATCH_COL, F.lit(-1).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(BATCH_COL).parquet(sink_path)


def stream_ingest(spark: SparkSession, source_path: str, schema: T.StructType, sink_path: str,
                  checkpoint: str, fmt: str = "parquet", totals: Mapping[str, int] | None = None,
                  queries: DataFrame | None = None, watermark: tuple[str, str] | None = None,
                  max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the ingest stream from ``source_path`` into the parquet ``sink_path``.

    ``watermark=(ts_col, delay)`` marks late rows: those more than ``delay`` behind the
    newest time stored before their batch. They are ingested like all others - a
    stateful operator would drop them - and written to the side table
    ``<sink>_late`` as well, one folder per batch, so they can be counted. A text
    ``ts_col`` is parsed (ISO or the ``Wed Oct 10 ...`` form) first."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = reader.load(source_path).withColumn(STORED_COL, F.lit(False))
    if _exists(spark, seed_path(sink_path)):  # all of it comes with the first batch
        keys = T.StructType([schema[c] for c in ops.COLLECTION_KEY])
        rows = rows.unionByName(spark.readStream.schema(keys).parquet(seed_path(sink_path)).withColumn(STORED_COL, F.lit(True)),
                                allowMissingColumns=True)
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state on disk, not in the heap
    stream = with_unseen(rows, schema)
    names, ts = schema.fieldNames(), watermark[0] if watermark else None
    own_adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def process(batch: DataFrame, batch_id: int) -> None:
        # a stream plans without AQE, as its state has a fixed number of parts; what reads the finished batch need not have as many
        conf, adaptive = batch.sparkSession.conf, "spark.sql.adaptive.enabled"
        was = conf.get(adaptive)
        conf.set(adaptive, own_adaptive)
        batch.persist()
        try:
            ingest(batch, batch_id)
        finally:
            batch.unpersist()
            conf.set(adaptive, was)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        arrived = ~F.col(STORED_COL) & ~F.col(UNSEEN_COL)
        before = _counts_before(batch.sparkSession, sink_path, batch_id, ts)
        if watermark:
            newest = before.agg(F.max("newest").alias("newest")).select("newest").scalar()
            late = batch.where(arrived).filter(parse_ts(ts) < newest - F.expr(f"interval {watermark[1]}")).select(*names)
            if late.agg(F.count(F.lit(1))).first()[0]:  # most batches have none: no need to know the new keys for them
                new_keys = batch.where(F.col(STORED_COL) | F.col(UNSEEN_COL)).groupBy(*ops.COLLECTION_KEY).agg(
                    F.bool_or(STORED_COL).alias(STORED_COL)).where(~F.col(STORED_COL)).drop(STORED_COL)
                late = late.join(new_keys, list(ops.COLLECTION_KEY), "left_semi").select(*names).unionByName(late.where(_no_key(schema)))
                _write(late, batch_id, late_path(sink_path))
        # as dedupe_keep_first, in the aggregate that also says whether the key is new
        order = arrival_order(batch.select(*names))
        if list(order) != list(ARRIVAL):
            order = [*order, *[c for c in names if c not in order]]
        first = F.min_by(F.when(arrived, F.struct(*names)), F.when(arrived, F.struct(*order)))
        new = (batch.groupBy(*ops.COLLECTION_KEY)
               .agg(first.alias("_first"), F.bool_or(STORED_COL).alias(STORED_COL), F.bool_or(UNSEEN_COL).alias(UNSEEN_COL))
               .where(F.col("_first").isNotNull() & (_no_key(schema) | (F.col(UNSEEN_COL) & ~F.col(STORED_COL)))).select("_first.*"))
        if totals is not None:
            qs = queries if queries is not None else new.select("collection_type", "query").distinct()
            new = ops.apply_quota(new, before.select("collection_type", "query", "already"), qs, totals)
        _write(new.select(*names), batch_id, sink_path)
        if totals is not None or watermark:
            path = f"{sink_path.rstrip('/')}/{BATCH_COL}={batch_id}"  # one partition; none if the batch had nothing new
            newest = parse_ts(ts) if ts else F.lit(None).cast("timestamp")
            if _exists(batch.sparkSession, path):
                mine = batch.sparkSession.read.schema(schema).parquet(path)
                before = before.unionByName(mine.select("collection_type", "query", F.lit(1).cast("long").alias("already"), newest.alias("newest")))
            now = before.groupBy("collection_type", "query").agg(F.sum("already").alias("already"), F.max("newest").alias("newest"))
            _write(now, batch_id, counts_path(sink_path))

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
