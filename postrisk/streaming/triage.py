"""Triage of arriving posts with frozen parameters (no state needed).

Min-max bounds are fitted once on a reference table and passed as numbers,
the probability comes from a column or a scorer, and every expression is
row-local, so the batch operator runs unchanged on the stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postrisk.operators.features import NORM_COLUMNS, apply_minmax
from postrisk.operators.triage import triage


def frozen_params(params: DataFrame) -> dict:
    """The 1-row fitted statistics as plain numbers (a handful of values)."""
    row = params.first()
    return {k: float(v) for k, v in row.asDict().items()}


def triage_stream(stream: DataFrame, params: Mapping[str, float],
                  scorer: Callable[[DataFrame], DataFrame] | None = None, weights=None) -> DataFrame:
    scaled = apply_minmax(stream, params, NORM_COLUMNS)
    if scorer is not None:
        scaled = scorer(scaled)
    return triage(scaled, weights)


def stream_triage(spark: SparkSession, source_path: str, schema: T.StructType, sink_path: str,
                  checkpoint: str, params: Mapping[str, float], scorer=None, weights=None,
                  available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Start the triage stream from ``source_path`` into the parquet ``sink_path``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_path)
    out = triage_stream(stream, params, scorer, weights)
    w = out.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
