"""Reference-shaped tables derived by Spark from the driver's tables.

The driver ships ``documents``/``events``/``labels``; these functions turn them
into raw posts, scored posts, annotator sheets and model responses (the
definitions are in FIXTURES.md; the SQL oracle builds the same tables).
Everything is a plain DataFrame plan: work grows with the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrisk.session import read_table

_MEMO: dict = {}


def _memo(fn):
    """Same DataFrame object for the same (session, folder): plans are built once
    and identical sub-plans are recognised (exchange reuse) when combined."""
    def wrapped(spark, sf_dir):
        key = (fn.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _MEMO:
            _MEMO[key] = fn(spark, sf_dir)
        return _MEMO[key]
    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    return wrapped

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
TW_FORMAT = "EEE MMM dd HH:mm:ss '+0000' yyyy"
SCRAPED_AT = "2024-02-01T00:00:00+00:00"


@_memo
def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as two collections would deliver them: 40 % of documents targeted,
    80 % random (20 % arrive twice), plus planted dirt. Arrival order is
    ``(source_rank, row_ord)``. Tables meet on the post's id: where their join deals the
    texts out, what is grouped by that id next moves them no second time."""
    post_id = F.col("doc_id").cast("string").alias("post_id")
    docs = read_table(spark, sf_dir, "documents").select(post_id, "doc_id", "source", "lang", "text")
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    labels = read_table(spark, sf_dir, "labels").select(post_id, "toxic")
    n = docs.select(F.count(F.lit(1))).scalar()
    et = F.col("event_type")
    eng = (events.select((F.col("event_id") % n).cast("string").alias("post_id"), et, "ts")
           .groupBy("post_id")
           .agg(F.sum(F.when(et == "view", 1).otherwise(0)).alias("likes"),
                F.sum(F.when(et == "click", 1).otherwise(0)).alias("reposts"),
                F.sum(F.when(et == "purchase", 1).otherwise(0)).alias("replies"),
                F.min("ts").alias("posted")))
    base = (docs.join(eng, "post_id", "left").join(labels, "post_id", "left")
            .select("post_id", "doc_id", "source", "lang", "text",
                    F.coalesce("toxic", F.lit(0)).alias("toxic"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("likes", "reposts", "replies")],
                    F.coalesce("posted", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("posted")))
    five = F.col("doc_id") % 5
    # both collection copies from one scan: 40 % targeted, 80 % random
    copies = F.filter(
        F.array(F.struct(F.lit(0).alias("source_rank"), F.lit("targeted").alias("collection_type"),
                         F.lit(0).alias("extra")),
                 F.struct(F.lit(1).alias("source_rank"), F.lit("random").alias("collection_type"),
                          F.lit(1).alias("extra"))),
        lambda c: F.when(c["source_rank"] == 0, five.isin(0, 1)).otherwise(five.isin(1, 2, 3, 4)))
    both = base.select("*", F.inline(copies))
    d = F.col("doc_id")
    return both.select(
        "source_rank",
        d.alias("row_ord"),
        "post_id",
        F.col("source").alias("query"),
        "collection_type",
        F.when((F.col("source_rank") == 0) & (d % 97 == 0), F.lit(None).cast("string"))
         .when(d % 89 == 0, F.lit("   ")).when(d % 101 == 0, F.lit("see @https:// now"))
         .when(d % 103 == 0, F.lit("@www.")).otherwise(F.col("text")).alias("text"),
        F.when(d % 83 == 0, F.lit("abc")).when(d % 107 == 0, F.lit("\t5"))
         .otherwise((F.col("likes") + F.col("extra")).cast("string")).alias("likes"),
        F.col("reposts").cast("string").alias("reposts"),
        F.col("replies").cast("string").alias("replies"),
        F.when(d % 79 == 0, F.lit("garbage")).when(d % 109 == 0, F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss"))
         .when(d % 2 == 0, F.date_format("posted", ISO_FORMAT))
         .otherwise(F.date_format("posted", TW_FORMAT)).alias("timestamp_utc"),
        F.concat("lang", F.lit("_"), "source").alias("author_username"),
        F.lit(SCRAPED_AT).alias("scraped_at_utc"),
    )


@_memo
def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already in the collection tables (incremental ingest state)."""
    return stored(raw_posts(spark, sf_dir))


def stored(raw: DataFrame) -> DataFrame:
    """The stored rows among raw posts."""
    return raw.filter(F.col("row_ord") % 3 == 0)


def hoax_probability(df: DataFrame, spark: SparkSession, sf_dir: str,
                     key: str = "post_id", out: str = "P_hoax") -> DataFrame:
    """Deterministic stand-in for a model probability (has ties, depends on the label)."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias(key), "toxic")
    doc = F.col(key).cast("long")
    p = (F.coalesce("toxic", F.lit(0)) * 300 + (doc * 7919) % 700).cast("double") / 1000.0
    return df.join(labels, key, "left").withColumn(out, p).drop("toxic")


@_memo
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label row, with ``label = toxic`` (the hoax label)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("post_id"), "text", F.col("toxic").alias("label"))


def _ratings(spark: SparkSession, sf_dir: str, lone: int | None = None) -> DataFrame:
    """Long table ``(post_id, annotator, label)``: three annotators for each labelled
    document, one for every ``lone``-th; every 41st has no label at all."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    t, d = F.col("toxic"), F.col("doc_id")
    none = F.lit(None).cast(labels.schema["toxic"].dataType)
    t = F.when(d % 41 == 0, none).otherwise(t)  # a post nobody labelled
    a1 = t
    a2 = F.when(d % 11 == 0, 1 - t).otherwise(t)
    a3 = F.when(d % 7 == 0, 1 - t).otherwise(t)
    votes = F.array(
        F.struct(F.lit("annotator_1").alias("annotator"), a1.alias("label")),
        F.struct(F.lit("annotator_2").alias("annotator"), a2.alias("label")),
        F.struct(F.lit("annotator_3").alias("annotator"), a3.alias("label")),
    )
    if lone:
        votes = F.when(d % lone == 0, F.slice(votes, 1, 1)).otherwise(votes)  # a post with one rater
    return (labels.select(d.cast("string").alias("post_id"), F.inline(votes))
            .select("post_id", "annotator", F.col("label").cast("int").alias("label")))


@_memo
def annotator_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table ``(post_id, annotator, label)``: three annotators for each labelled
    document; every 37th post has one rater, every 41st no label at all."""
    return _ratings(spark, sf_dir, lone=37)


@_memo
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labeller replies with prose around the JSON; label 7 (invalid) every 13th, broken
    JSON every 29th, no object every 31st."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = F.col("doc_id")
    lab = F.when(d % 13 == 0, F.lit(7)).otherwise(F.col("toxic"))
    raw = F.concat(F.lit('note {"label": '), lab.cast("string"), F.lit(', "reason": " r'),
                   d.cast("string"), F.lit(' "} end'))
    raw = F.when(d % 29 == 0, F.lit("so {bad} it is")).when(d % 31 == 0, F.lit("no object")).otherwise(raw)
    return labels.select(d.cast("string").alias("post_id"), raw.alias("raw_response"))


def _with_gaps(ann: DataFrame) -> DataFrame:
    doc = F.col("post_id").cast("long")
    ann = ann.filter(~((F.col("annotator") == "annotator_3") & (doc % 17 == 0)))
    return ann.withColumn("label", F.when((F.col("annotator") == "annotator_2") & (doc % 19 == 0),
                                          F.lit(None).cast("string"))
                          .when(doc % 43 == 0, F.col("label").cast("double").cast("string"))
                          .otherwise(F.col("label").cast("string")))


@_memo
def incomplete_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotator sheets with gaps: annotator_3 skips every 17th post and
    annotator_2 left every 19th label empty (for the sheet checks); every 43rd label is a
    number with a fraction, as spreadsheets write it."""
    return _with_gaps(annotator_labels(spark, sf_dir))


@_memo
def sheets_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets that labelling resumes, with the gaps of ``incomplete_sheets``: each post is on
    every annotator's sheet but for those gaps, none has one rater only."""
    return _with_gaps(_ratings(spark, sf_dir))
