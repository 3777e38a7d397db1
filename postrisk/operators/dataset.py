"""Exact stratified split, split report, leakage check, class weights, sequence encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postrisk.constants import MAX_SEQ_LEN, SPLIT_RATIOS, SPLIT_SEED
from postrisk.functions.text import words
from postrisk.operators.ranking import CUT_BINS, rank_cuts, rank_histogram, small_side
from postrisk.session import materialize

PAD_ID = 0
UNK_ID = 1
VOCAB_SIZE = 30000
BROADCAST_MAX_TERMS = 2_000_000


def _uniform_hash(key: str, seed: int):
    """Deterministic pseudo-random number in [0, 1) from the key and the seed."""
    # 13 hexadecimal digits of md5: any SQL engine can compute the same split
    h = F.substring(F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(key).cast("string"))), 1, 13)
    return F.conv(h, 16, 10).cast("double") / float(1 << 52)


def _largest_remainder(counts: DataFrame, label: str, total_col: str, quota_col: str, out: str) -> DataFrame:
    """Per-class share of ``quota_col`` proportional to ``total_col`` (floors, then the
    largest remainders get one more; ties go to the smaller label).
    ``counts`` has one row per class, so the un-partitioned windows are tiny."""
    every = Window.partitionBy(F.lit(1))
    exact = F.col(quota_col) * F.col(total_col) / F.sum(total_col).over(every)
    c = counts.withColumns({"_exact": exact, "_base": F.floor(exact).cast("long")})
    c = c.withColumns({"_short": F.col(quota_col) - F.sum("_base").over(every),
                       "_ord": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(
                           F.desc(F.col("_exact") - F.col("_base")), F.asc(label)))})
    return c.withColumn(out, F.col("_base") + F.when(F.col("_ord") <= F.col("_short"), 1).otherwise(0)) \
        .drop("_exact", "_base", "_short", "_ord")


def split_quotas(df: DataFrame, label: str = "label", ratios=SPLIT_RATIOS, counts: DataFrame | None = None) -> DataFrame:
    """Per-class test and validation counts: ``n_test = ceil(test*n)``, then
    ``n_val = ceil(val/(train+val) * (n - n_test))``, spread over classes by largest remainder.
    ``counts`` (label, n_class) saves counting."""
    train, val, test = ratios
    every = Window.partitionBy(F.lit(1))
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")) if counts is None else counts
    c = c.withColumn("_n_test", F.ceil(F.lit(float(test)) * F.sum("n_class").over(every)).cast("long"))
    c = _largest_remainder(c, label, "n_class", "_n_test", "n_test")
    c = c.withColumn("_rest", F.col("n_class") - F.col("n_test"))
    c = c.withColumn("_n_val", F.ceil(F.lit(float(val) / float(train + val))
                                      * F.sum("_rest").over(every)).cast("long"))
    c = _largest_remainder(c, label, "_rest", "_n_val", "n_val")
    return c.select(label, "n_class", "n_test", "n_val")


def stratified_split(df: DataFrame, label: str = "label", key: str = "post_id", ratios=SPLIT_RATIOS,
                     seed: int = SPLIT_SEED, buckets: int | None = None) -> DataFrame:
    """Adds ``split`` (train/val/test) with exact per-class counts.

    Rows are ordered inside each class by a seeded hash of the key; the first
    ``n_test`` go to test, the next ``n_val`` to validation, the rest to train. A histogram of the hashes and the
    order keys of one of its bins give the keys at those two ranks (``ranking.rank_cuts``); both small tables are
    written, and every row is then told by comparing its key with its class's cuts. Rows with their texts are
    neither ranked nor exchanged. ``buckets``: bins of the histogram (None: ``ranking.CUT_BINS``)."""
    bins = buckets or CUT_BINS
    u = _uniform_hash(key, seed)
    narrow = df.select(F.col(label), u.alias("_u"), F.col(key).alias("_key"))
    hist = materialize(rank_histogram(narrow, label, bins=bins), "split-histogram")  # bins rows a class
    q = split_quotas(df, label, ratios, hist.groupBy(label).agg(F.max("_hi").alias("n_class")))
    ranks = q.select(label, F.col("n_test").alias("_test"), (F.col("n_test") + F.col("n_val")).alias("_val"))
    cuts = materialize(rank_cuts(narrow, label, hist, ranks, ["_test", "_val"], bins=bins), "split-cuts")  # a row a class
    me = F.struct(u, F.col(key))

    def within(cut):
        return F.col(cut).isNotNull() & (me <= F.col(cut))
    return (df.join(small_side(cuts), label, "left")
            .withColumn("split", F.when(within("_test"), "test").when(within("_val"), "val").otherwise("train"))
            .drop("_test", "_val"))


def split_sizes(split: DataFrame) -> DataFrame:
    """Rows and share per split."""
    total = split.select(F.count(F.lit(1))).scalar()
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.col("n") / total)


def split_leakage(split: DataFrame, key: str = "post_id") -> DataFrame:
    """D3: keys present in more than one split (must be empty)."""
    return (split.groupBy(key).agg(F.count_distinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def assert_no_leakage(split: DataFrame, key: str = "post_id") -> None:
    bad = split_leakage(split, key).limit(1).count()
    if bad:
        raise RuntimeError("data leakage: a key is in more than one split")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``round(total / (n_classes * count), 4)`` (half-even)."""
    every = Window.partitionBy(F.lit(1))
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return c.withColumn("weight", F.bround(w, 4))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "label",
                      out: str = "weight") -> DataFrame:
    """Joins the per-class weight on as a ``weightCol`` for training."""
    return df.join(weights.select(label, F.col("weight").alias(out)), label, "left")


# ---------------------------------------------------------------- D5

def fit_vocab(df: DataFrame, text_col: str = "text", size: int = VOCAB_SIZE) -> DataFrame:
    """Word vocabulary of the most frequent terms (ties by term); ids start at 2
    (0 = padding, 1 = unknown). Counting runs on the executors; only ``size``
    rows survive the top-k."""
    terms = df.select(F.explode(words(text_col)).alias("term"))
    top = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.asc("term")).limit(int(size))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.asc("term"))
    return top.withColumn("id", (F.row_number().over(w) + 1).cast("int"))


def encode(df: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "post_id",
           max_len: int = MAX_SEQ_LEN, vocab_size: int = VOCAB_SIZE, label: str | None = "label") -> DataFrame:
    """The whole text is tokenised (``n_tokens`` counts every word); the first
    ``max_len`` tokens are mapped to ids, padded with 0, with an attention mask.

    The vocabulary has at most ``vocab_size`` rows (a proven bound), so it is
    broadcast up to ``BROADCAST_MAX_TERMS``; the per-post regrouping is combined
    map-side because all tokens of a post stay in its partition."""
    v = vocab.select(F.col("term").alias("_term"), F.col("id").alias("_id"))
    if vocab_size <= BROADCAST_MAX_TERMS:
        v = F.broadcast(v)
    keep = [key] + ([label] if label and label in df.columns else [])
    toks = df.select(*keep, words(text_col).alias("_w"))
    toks = toks.select(*keep, F.size("_w").alias("n_tokens"),
                       F.posexplode_outer(F.slice("_w", 1, max_len)).alias("_pos", "_term"))
    ids = toks.join(v, "_term", "left").withColumn(
        "_id", F.when(F.col("_term").isNotNull(), F.coalesce("_id", F.lit(UNK_ID))))
    agg = ids.groupBy(*keep, "n_tokens").agg(
        F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_pos", "_id")))).alias("_p"))
    seq = F.transform("_p", lambda s: s["_id"])
    out = agg.withColumn("_ids", seq).withColumn(
        "input_ids", F.concat("_ids", F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size("_ids"))))
    out = out.withColumn("attention_mask",
                         F.transform("input_ids", lambda x, i: F.when(i < F.size("_ids"), 1).otherwise(0)))
    return out.drop("_p", "_ids")
