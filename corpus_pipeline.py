"""Training-data pipeline over ``documents``: five stages, each one of the numbered operators.

Every stage reads what the one before kept, from Parquet in the checkpoint
folder, and its decisions take effect; all but the last return the columns of documents.
A decision holds for one row, not for its id: ids may be null or shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrisk.llm import op2_quality_crf, op4_pii
from postrisk.llm.common import read, write_cut
from postrisk.llm.op3_decontaminate import decontaminate
from postrisk.llm.op6_near_dups import near_dups
from postrisk.llm.op8_mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a key of their own for each row, written, so that every later read sees the same keys.

    Ids don't tell rows apart: they may be null or shared."""
    return write_cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), f"rows-{name}")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad go."""
    model = op2_quality_crf.train(docs, read(spark, sf_dir, "labels"))
    # the decision comes beside the row, so nothing is joined
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return op2_quality_crf.quality(rows, model, id_col="row").where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (null last).

    Texts without words are copies of nothing but rows of the same id and text."""
    keyed = _keyed(docs, "near")
    found = near_dups(keyed, id_col="row").select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    of = keyed.select("row", "doc_id", F.xxhash64("text").alias("tie"), F.xxhash64("lang", "source", "n_chars").alias("rest"))
    blank = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~blank, F.col("component_id")).alias("a"), *[F.when(blank, F.col(c)).alias(f"blank_{c}") for c in ("doc_id", "tie")]]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie", "rest", "row"))["row"]
    stay = of.join(found, "row").groupBy(*group).agg(first.alias("row")).select("row")
    return keyed.join(stay, "row", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark window go."""
    keyed = _keyed(docs, "decon")
    bad = decontaminate(keyed, read(spark, sf_dir, "benchmark"), id_col="row").where("contaminated").select("row")
    return keyed.join(bad, "row", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span gives way to its kind in angle brackets; n_chars follows. No document goes."""
    return op4_pii.redacted_table(docs, op4_pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how often the mix takes each; those that it takes no copy of go."""
    keyed = _keyed(docs, "mix")
    taken = mix(keyed, row_col="row").where("copies > 0").select("row", "size", "source_size", "target", "copies", "taken")
    return keyed.join(taken, "row").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: SQL can't express sketches, trained models or Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
