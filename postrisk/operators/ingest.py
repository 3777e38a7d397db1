"""Incremental ingest: stored state, de-dup against it, per-query quotas, record
normalisation and topic tagging (batch; the stream version is in ``streaming``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.constants import RANDOM_KEYWORDS, RANDOM_PER_KEYWORD, TARGETED_RATIO, TOTAL_TARGET
from postrisk.functions.text import clean_text, words
from postrisk.operators.cleaning import arrival_order, dedupe_keep_first
from postrisk.operators.ranking import first_n_per_group

COLLECTION_KEY = ("collection_type", "post_id")


def existing_state(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids already stored per collection, and rows per (collection, query)."""
    ids = stored.select(*COLLECTION_KEY).distinct()
    counts = stored.groupBy("collection_type", "query").agg(F.count(F.lit(1)).alias("already"))
    return ids, counts


def ingest_new(batch: DataFrame, stored: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of the batch whose id is not stored in the same collection yet;
    inside the batch the first arrival wins. Anti join, then keep-first."""
    new = batch.join(stored.select(*COLLECTION_KEY).distinct(), list(COLLECTION_KEY), "left_anti")
    order = arrival_order(new) if order_cols is None else [c for c in order_cols if c in new.columns]
    keyed = new.withColumn("_key", F.struct(*COLLECTION_KEY))
    return dedupe_keep_first(keyed, "_key", order).drop("_key")


def allocate_targets(total: int = TOTAL_TARGET, ratio: float = TARGETED_RATIO,
                     per_keyword: int = RANDOM_PER_KEYWORD, n_random: int = len(RANDOM_KEYWORDS)) -> dict:
    """I4: collection totals: targeted ``int(total * ratio)``, random ``per_keyword * n``."""
    return {"targeted": int(total * ratio), "random": int(per_keyword * max(1, n_random))}


def apply_quota(new: DataFrame, counts: DataFrame, queries: DataFrame, totals: Mapping[str, int],
                order_cols: Sequence[str] = ("row_ord", "post_id")) -> DataFrame:
    """Per query at most ``limit - already`` new rows, ``limit = max(1, total //
    max(1, n_queries))`` per collection; queries already at their limit get none.

    No query takes more than the largest total, so every task sends that many of its rows at
    most; beyond ``ranking.GROUP_LIMIT`` ranks come from the bucketed ranking instead."""
    tot = F.lit(None).cast("long")
    for k, v in totals.items():
        tot = F.when(F.col("collection_type") == k, F.lit(int(v))).otherwise(tot)
    nq = queries.groupBy("collection_type").agg(F.count_distinct("query").alias("_nq"))
    limits = (queries.select("collection_type", "query").distinct().join(nq, "collection_type")
              .withColumn("_limit", F.greatest(F.lit(1), F.floor(tot / F.greatest(F.lit(1), F.col("_nq")))))
              .join(counts, ["collection_type", "query"], "left")
              .select("collection_type", "query",
                      (F.col("_limit") - F.coalesce("already", F.lit(0))).alias("_remaining")))
    todo = new.join(limits.filter(F.col("_remaining") > 0), ["collection_type", "query"])
    most = max([1, *map(int, totals.values())])
    return first_n_per_group(todo, ["collection_type", "query"], list(order_cols), "_remaining", most).drop("_remaining")


def normalise_records(df: DataFrame, query: str | None = None, collection_type: str | None = None,
                      scraped_at=None) -> DataFrame:
    """Missing counts -> 0, missing text/author -> "", timestamp as ISO text,
    tagged with query/collection and the scrape time (now unless given)."""
    ts = F.col("timestamp_utc")
    iso = F.coalesce(_iso_utc(ts.try_cast("timestamp")), ts.cast("string"), F.lit(""))
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in ("likes", "reposts", "replies")}
    return df.withColumns({
        "likes": F.coalesce(F.col("likes"), zero["likes"]),
        "reposts": F.coalesce(F.col("reposts"), zero["reposts"]),
        "replies": F.coalesce(F.col("replies"), zero["replies"]),
        "text": F.coalesce(F.col("text"), F.lit("")),
        "author_username": F.coalesce(F.col("author_username"), F.lit("")),
        "timestamp_utc": iso,
        "query": F.lit(query) if query is not None else F.col("query"),
        "collection_type": F.lit(collection_type) if collection_type is not None else F.col("collection_type"),
        "scraped_at_utc": _iso_utc(F.current_timestamp()) if scraped_at is None
        else F.lit(scraped_at).cast("string"),
    })


def _iso_utc(ts):
    """ISO-8601 text of an instant in UTC (``...+00:00``), whatever the session time zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def topic_table(spark, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """(topic, phrase) rows from a parameter list."""
    return spark.createDataFrame(list(phrases), "topic string, phrase string")


BROADCAST_MAX_TOPIC_WORDS = 1_000_000


def anchored_topics(posts: DataFrame, topics: DataFrame, text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """(topic, _words, _anchor): each topic with its words and the one that fewest posts have.

    Only posts' words that some topic has are counted, combined map-side, so the
    count table is as long as the topics' vocabulary."""
    t = topics.select("topic", F.array_distinct(words(clean_text("phrase"))).alias("_words")).filter(F.size("_words") > 0)
    terms = t.select(F.explode("_words").alias("_term")).distinct()
    if terms.count() <= BROADCAST_MAX_TOPIC_WORDS:
        terms = F.broadcast(terms)
    body = F.col(text_col) if cleaned else clean_text(text_col)
    df = (posts.select(F.explode(F.array_distinct(words(body))).alias("_term")).join(terms, "_term")
          .groupBy("_term").agg(F.count(F.lit(1)).alias("_df")))
    rank = F.struct(F.coalesce("_df", F.lit(0)).alias("n"), F.col("_term").alias("term"))
    return (t.select("topic", "_words", F.explode("_words").alias("_term")).join(df, "_term", "left")
            .groupBy("topic", "_words").agg(F.min(rank)["term"].alias("_anchor")))


def tag_topics(posts: DataFrame, topics: DataFrame, text_col: str = "text", key: str = "post_id",
               cleaned: bool = True) -> DataFrame:
    """(post, topic) for every topic whose words all occur in the post
    (case-insensitive, on cleaned words; word order is free).

    A post can only hit a topic if it has the topic's rarest word, so posts join the
    topics on that anchor alone and the other words are tested in the joined row:
    joined rows stay near the number of anchor hits. The anchor table
    (configuration-sized) is counted and broadcast below a fixed bound; beyond it
    post words join narrowly and the posts' words are fetched for the candidates."""
    anchors = anchored_topics(posts, topics, text_col, cleaned)
    body = F.col(text_col) if cleaned else clean_text(text_col)
    bag = posts.select(key, F.array_distinct(words(body)).alias("_bag"))
    holds = F.size(F.array_except("_words", "_bag")) == 0
    if topics.count() <= BROADCAST_MAX_TOPIC_WORDS:
        hits = bag.select(key, "_bag", F.explode("_bag").alias("_anchor")).join(F.broadcast(anchors), "_anchor")
    else:
        found = bag.select(key, F.explode("_bag").alias("_anchor")).join(anchors, "_anchor")
        hits = found.join(bag, key)
    return hits.filter(holds).select(key, "topic").distinct()
