"""A4 with a ledger: labelling that survives a stopped run and tries failed rows again.

A piece of work is a post, an annotator and a prompt, named by the hash of the three; a sheet that
repeats one has it labelled once. Work is dealt by its name into ``BUCKETS`` buckets, and the ledger is a
table of attempts, append-only and partitioned by bucket.

A run goes through the attempts in turn and, within one, through ``commits`` groups of buckets. A
group is one job: it reads its own buckets of the work and of the ledger, takes what has no success and
exactly one attempt less, labels it in the tasks and appends the attempts in one commit. A run that ends
half way loses the group it was in and no other; the next run finds its place by the ledger, so no
committed work is labelled again. The ``k``-th attempt of an annotator uses its seed + k - 1.

Nothing but the number of open rows comes to the driver. One run at a time may write a ledger. A changed
text, guideline or annotator name is other work; its old attempts stay in the ledger and are ignored.

Defined results: given labels are kept and make no attempt; null texts, ids and annotators are work like any
other (they never match "" or each other's neighbours); an empty sheet gives an empty result; extra columns are
ignored. What still failed after ``max_attempts`` has no label and the reason of its last attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrisk.constants import ANNOTATORS, EXISTING_LABEL_REASON, LABEL_PROMPT_GUIDE
from postrisk.operators.annotation import LabelFn, annotate, build_prompt, check_sheet_schema, existing_label
from postrisk.session import release, scratch_path
from postrisk.sources.io import _exists

BUCKETS = 64
LEDGER_SCHEMA = "work string, post_id string, annotator string, label int, reason string, attempt int, bucket int"


def work_name(guideline: str = LABEL_PROMPT_GUIDE) -> F.Column:
    """The hash of post_id, annotator and prompt; null fields are left out of the hashed object."""
    return F.sha2(F.to_json(F.struct("post_id", "annotator", build_prompt("text", guideline).alias("prompt"))), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All attempts; empty where nothing was committed yet."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER_SCHEMA)


def ledger_state(attempts: DataFrame) -> DataFrame:
    """work, tries, label, reason: the first success of each piece of work, or its last failure."""
    last = F.max_by(F.struct("label", "reason"), F.struct(F.col("label").isNotNull(), F.when(F.col("label").isNotNull(), -F.col("attempt")).otherwise(F.col("attempt"))))
    return attempts.groupBy("work").agg(F.max("attempt").alias("tries"), last.alias("s")).select("work", "tries", "s.label", "s.reason")


def _sheet(sheets: DataFrame, guideline: str) -> DataFrame:
    base = check_sheet_schema(sheets).select(F.col("post_id").cast("string").alias("post_id"), "annotator", "text", existing_label("label").alias("given"))
    return base.withColumn("work", work_name(guideline))


def run_ledger(sheets: DataFrame, label_fn: LabelFn, path: str, annotators: Sequence[tuple[str, float, int]] = ANNOTATORS,
               guideline: str = LABEL_PROMPT_GUIDE, commits: int = 8, max_attempts: int = 3, stop_after: int | None = None) -> int:
    """Label what the ledger at ``path`` lacks; the number of commits that had work. ``commits`` is at most BUCKETS.
    ``stop_after`` ends the run after so many commits."""
    spark = sheets.sparkSession
    todo = _sheet(sheets, guideline).where("given is null").select("work", "post_id", "annotator", "text").dropDuplicates(["work"])
    todo = todo.withColumn("bucket", F.conv(F.substring("work", 1, 8), 16, 10).cast("long").bitwiseAND(BUCKETS - 1).cast("int"))
    place = scratch_path(spark, "ledger-work")
    todo.write.partitionBy("bucket").parquet(place)
    work = spark.read.schema(todo.schema).parquet(place)
    done = 0
    for attempt in range(1, max_attempts + 1):
        shifted = [(name, t, s + attempt - 1) for name, t, s in annotators]
        for group in range(commits):
            mine = [b for b in range(BUCKETS) if b % commits == group]
            state = ledger_state(read_ledger(spark, path).where(F.col("bucket").isin(mine)))
            left = work.where(F.col("bucket").isin(mine)).join(state.select("work", "tries", F.col("label").alias("known")), "work", "left") \
                .where(F.col("known").isNull() & (F.coalesce("tries", F.lit(0)) == attempt - 1))
            if left.select("work").isEmpty():
                continue
            if stop_after is not None and done >= stop_after:
                release(spark, [place])
                return done
            made = annotate(left.select("post_id", "annotator", "text", F.lit(None).cast("string").alias("label")), label_fn, shifted, guideline)
            made = made.withColumn("work", work_name(guideline)).select(
                "work", "post_id", "annotator", "label", F.col("auto_reason").alias("reason"), F.lit(attempt).alias("attempt"),
                F.conv(F.substring("work", 1, 8), 16, 10).cast("long").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket"))
            made.write.mode("append").partitionBy("bucket").parquet(path)
            done += 1
    release(spark, [place])
    return done


def labelled(sheets: DataFrame, path: str, guideline: str = LABEL_PROMPT_GUIDE) -> DataFrame:
    """post_id, annotator, label, auto_reason, attempts of every sheet row, by what the ledger holds now. Work
    that has no attempt yet has neither label nor reason."""
    state = ledger_state(read_ledger(sheets.sparkSession, path)).withColumnsRenamed({"label": "made", "reason": "why"})
    given = F.col("given").isNotNull()
    return _sheet(sheets, guideline).join(state, "work", "left").select(
        "post_id", "annotator", F.coalesce("given", "made").alias("label"),
        F.when(given, EXISTING_LABEL_REASON).otherwise(F.col("why")).alias("auto_reason"),
        F.when(given, 0).otherwise(F.coalesce("tries", F.lit(0))).alias("attempts"))
