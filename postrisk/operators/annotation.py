"""Annotation sheets, labelling, sheet checks, majority vote, Fleiss' kappa and label joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postrisk.constants import (
    ANNOTATORS, EXISTING_LABEL_REASON, HOAX_SHARE_RANGE, KAPPA_TARGET, LABEL_PROMPT_GUIDE,
    LABEL_PROMPT_SYSTEM,
)
from postrisk.functions.text import NOT_SPACE

ANNOTATOR_NAMES = tuple(a[0] for a in ANNOTATORS)
_WS = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"


def _strip(c):
    """Python ``str.strip()``: trims Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


# ---------------------------------------------------------------- A1-A3, A6

def make_sheets(posts: DataFrame, annotators: Sequence[str] = ANNOTATOR_NAMES) -> DataFrame:
    """A1: every post once per annotator, label empty. A generator (``explode``)
    over the annotator list, not a join: each post row is simply repeated."""
    names = F.array(*[F.lit(a) for a in annotators])
    return posts.select("post_id", "text", F.explode(names).alias("annotator"),
                        F.lit(None).cast("int").alias("label"))


def check_sheet_schema(df: DataFrame) -> DataFrame:
    """A2: ``post_id`` is required, ``text_clean`` is accepted for ``text``, a missing
    ``label`` column is added empty."""
    if "post_id" not in df.columns:
        raise ValueError("sheet has no post_id column")
    if "text" not in df.columns:
        if "text_clean" not in df.columns:
            raise ValueError("sheet has no text column")
        df = df.withColumnRenamed("text_clean", "text")
    if "label" not in df.columns:
        df = df.withColumn("label", F.lit(None).cast("string"))
    return df


def existing_label(c) -> F.Column:
    """A3: a label already given (``0``/``1`` after trimming, or the numbers 0/1, also 0.0/1.0)."""
    s = _strip(F.col(c).cast("string")) if isinstance(c, str) else _strip(c.cast("string"))
    return F.when(s.isin("0", "1", "0.0", "1.0"), s.cast("double").cast("int"))


def limit_per_annotator(df: DataFrame, n: int, order: str = "post_id") -> DataFrame:
    """The first ``n`` rows of each annotator's sheet, as a new table (the input is
    never truncated). A constant limit is planned as a per-partition group limit
    before the shuffle, so each task ships at most ``n`` rows per annotator."""
    from pyspark.sql import Window
    w = Window.partitionBy("annotator").orderBy(F.col(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- A4, A5

def build_prompt(text_col, guideline: str = LABEL_PROMPT_GUIDE) -> F.Column:
    """The labelling prompt, as a column (answer format, the caller's guideline, then the post)."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat(F.lit(LABEL_PROMPT_SYSTEM + "\n\n" + guideline + "Post:\n"), _strip(t))


LabelFn = Callable[[pd.Series, float, int], "tuple[pd.Series, pd.Series]"]

ANNOTATED_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()), T.StructField("annotator", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("auto_reason", T.StringType()),
])


def annotate(sheets: DataFrame, label_fn: LabelFn,
             annotators: Sequence[tuple[str, float, int]] = ANNOTATORS, guideline: str = LABEL_PROMPT_GUIDE) -> DataFrame:
    """A3/A4: keep labels already present (reason ``existing label``); label the rest
    with ``label_fn(prompts, temperature, seed) -> (labels, reasons)``, called once
    per Arrow batch inside the tasks (no per-row calls, nothing on the driver).
    Invalid labels (not 0/1) become null with the reason prefixed ``error:``.

    A model labeller need not be deterministic: write the result (``io.write_table``
    or ``session.materialize``) before using it twice, so a retried task cannot
    change labels between two reads."""
    sheets = check_sheet_schema(sheets)
    temp = F.lit(None).cast("double")
    seed = F.lit(None).cast("int")
    for name, t, s in annotators:
        temp = F.when(F.col("annotator") == name, F.lit(float(t))).otherwise(temp)
        seed = F.when(F.col("annotator") == name, F.lit(int(s))).otherwise(seed)
    base = sheets.select("post_id", "annotator", "text", existing_label("label").alias("_given"))
    done = base.filter(F.col("_given").isNotNull()).select(
        "post_id", "annotator", "text", F.col("_given").alias("label"),
        F.lit(EXISTING_LABEL_REASON).alias("auto_reason"))
    todo = base.filter(F.col("_given").isNull()).select(
        "post_id", "annotator", "text", build_prompt("text", guideline).alias("_prompt"),
        temp.alias("_temperature"), seed.alias("_seed"))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for (t, s), g in pdf.groupby(["_temperature", "_seed"], dropna=False, sort=False):
                labels, reasons = label_fn(g["_prompt"].reset_index(drop=True), t, s)
                lab = pd.to_numeric(pd.Series(list(labels)), errors="coerce")
                ok = lab.isin([0, 1])
                rs = pd.Series([str(r).strip() for r in reasons])
                rs[~ok] = "error: invalid label " + pd.Series(list(labels)).astype(str)[~ok]
                out.append(pd.DataFrame({
                    "post_id": g["post_id"].values, "annotator": g["annotator"].values,
                    "text": g["text"].values, "label": lab.where(ok).astype("Int32").values,
                    "auto_reason": rs.values}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return done.unionByName(todo.mapInPandas(run, ANNOTATED_SCHEMA))


def parse_label_response(c) -> F.Column:
    """A5: model reply -> struct(label int, reason string, error string).

    The JSON object is the text from the first ``{`` to the last ``}`` (code fences
    and prose around it are ignored); ``label`` may be a number or a quoted number
    and must be 0 or 1; ``reason`` is trimmed. Bad rows get ``error`` instead of
    failing the job."""
    raw = F.col(c) if isinstance(c, str) else c
    obj = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(obj != "", obj), "label string, reason string, _corrupt_record string",
                         {"columnNameOfCorruptRecord": "_corrupt_record"})
    num = parsed["label"].try_cast("double")
    lab = F.when(num == F.floor(num), num.try_cast("int"))
    valid = lab.isin(0, 1) & parsed["_corrupt_record"].isNull()
    error = (F.when(obj == "", F.lit("no json object"))
             .when(parsed.isNull() | parsed["_corrupt_record"].isNotNull(), F.lit("invalid json"))
             .when(~F.coalesce(valid, F.lit(False)), F.lit("invalid label")))
    return F.struct(F.when(valid, lab).alias("label"),
                    F.when(valid, F.coalesce(_strip(parsed["reason"]), F.lit(""))).alias("reason"),
                    error.alias("error"))


# ---------------------------------------------------------------- A7, A8

def is_unlabelled(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | ~F.coalesce(_strip(col.cast("string")).rlike(NOT_SPACE), F.lit(False))


def sheet_checks(long: DataFrame) -> DataFrame:
    """Rows and unlabelled rows per annotator (labelling must be complete)."""
    return long.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_if(is_unlabelled("label")).alias("n_unlabelled"))


def sheet_alignment(long: DataFrame, n_annotators: int = len(ANNOTATORS)) -> DataFrame:
    """Post ids not labelled exactly once by each annotator."""
    return (long.groupBy("post_id")
            .agg(F.count_distinct("annotator").alias("n_annotators"), F.count(F.lit(1)).alias("n_rows"))
            .filter((F.col("n_annotators") != n_annotators) | (F.col("n_rows") != n_annotators)))


# ---------------------------------------------------------------- A9-A12

def majority_vote(long: DataFrame) -> DataFrame:
    """Votes per post, majority label (``votes_hoax * 2 > n``; null without any vote),
    ambiguity (not unanimous)."""
    lab = F.col("label")
    v = long.groupBy("post_id").agg(F.count_if(lab == 1).alias("vote_hoax"),
                                    F.count_if(lab == 0).alias("vote_nonhoax"))
    n = F.col("vote_hoax") + F.col("vote_nonhoax")
    return v.withColumns({
        "label": F.when(n > 0, F.when(F.col("vote_hoax") * 2 > n, 1).otherwise(0)),
        "is_ambiguous": (F.col("vote_hoax") > 0) & (F.col("vote_nonhoax") > 0),
    }).select("post_id", "label", "is_ambiguous", "vote_hoax", "vote_nonhoax")


def fleiss_kappa(long: DataFrame, item: str = "post_id", category: str = "label") -> DataFrame:
    """A10: Fleiss' kappa for any number of categories, as a 1-row table.

    Agreement needs two ratings, so items with fewer are left out of every term.
    Two partial aggregations ((item, category) counts, then per item) and a
    category total table; the chance agreement is 1 -> kappa 1. The number of
    raters per item is reported (min/max) instead of being assumed constant."""
    nij = long.filter(F.col(category).isNotNull()).groupBy(item, category).agg(
        F.count(F.lit(1)).cast("double").alias("nij"))
    per_item = nij.groupBy(item).agg(F.sum(F.col("nij") * F.col("nij")).alias("sq"),
                                     F.sum("nij").alias("ni")).filter(F.col("ni") >= 2)
    nij = nij.join(per_item.select(item), item, "left_semi")
    p_i = (F.col("sq") - F.col("ni")) / (F.col("ni") * (F.col("ni") - 1))
    items = per_item.agg(F.count(F.lit(1)).alias("n_items"), F.avg(p_i).alias("p_bar"),
                         F.min("ni").cast("long").alias("n_raters_min"),
                         F.max("ni").cast("long").alias("n_raters_max"),
                         F.sum("ni").alias("total"))
    total = items.select("total").scalar()
    p_e = nij.groupBy(category).agg(F.sum("nij").alias("tj")).select(
        F.sum((F.col("tj") / total) ** 2).alias("p_e")).scalar()
    kappa = F.when(p_e == 1.0, F.lit(1.0)).otherwise(F.try_divide(F.col("p_bar") - p_e, 1.0 - p_e))
    return items.select(kappa.alias("kappa"), "p_bar", p_e.alias("p_e"), "n_items", "n_raters_min",
                        "n_raters_max")


def agreement_gate(long: DataFrame, target: float = KAPPA_TARGET) -> DataFrame:
    """Kappa against the target and the share of ambiguous items, both over the
    items with at least two ratings."""
    k = fleiss_kappa(long)
    votes = majority_vote(long).filter(F.col("vote_hoax") + F.col("vote_nonhoax") >= 2)
    amb = votes.agg(F.count_if("is_ambiguous").alias("n_ambiguous"), F.count(F.lit(1)).alias("n_items"))
    s = amb.select(F.struct("n_ambiguous", "n_items")).scalar()
    return k.select("kappa", (F.col("kappa") >= target).alias("passed"),
                    s["n_ambiguous"].alias("n_ambiguous"),
                    F.try_divide(s["n_ambiguous"] * 100.0, s["n_items"]).alias("pct_ambiguous"))


def reannotation_queue(votes: DataFrame, posts: DataFrame) -> DataFrame:
    """Ambiguous items with their text, to be labelled again."""
    return votes.filter("is_ambiguous").join(posts.select("post_id", "text"), "post_id").select(
        "post_id", "text", "vote_hoax", "vote_nonhoax")


# ---------------------------------------------------------------- A13-A16

def attach_votes(cleaned: DataFrame, votes: DataFrame) -> DataFrame:
    """Every cleaned post, with label/ambiguity/votes where voted."""
    return cleaned.join(votes.select("post_id", "label", "is_ambiguous", "vote_hoax", "vote_nonhoax"),
                        "post_id", "left")


def merge_labels(cleaned: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inner join with an external label table; label coerced to a nullable int.
    Also returns the cleaned posts without a label (anti join, robust to repeats)."""
    lab = labels.select("post_id", F.col("label").cast("string").try_cast("double").alias("_l"))
    lab = lab.select("post_id", F.when(F.col("_l") == F.floor("_l"), F.col("_l").try_cast("int"))
                     .alias("label"))
    merged = cleaned.join(lab, "post_id", "inner")
    unmatched = cleaned.join(labels.select("post_id"), "post_id", "left_anti")
    return merged, unmatched


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage (2 decimals) per label; null labels left out."""
    lab = df.filter(F.col(label).isNotNull())
    total = lab.select(F.count(F.lit(1))).scalar()
    return lab.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", F.round(F.col("n") * 100.0 / total, 2))


def target_range(df: DataFrame, lo: float = HOAX_SHARE_RANGE[0], hi: float = HOAX_SHARE_RANGE[1],
                 label: str = "label") -> DataFrame:
    """Positive share and whether it lies in ``[lo, hi]`` (both inclusive)."""
    lab = F.col(label)
    agg = df.agg(F.count(lab).alias("n"), F.count_if(lab == 1).alias("n_pos"))
    share = F.col("n_pos") / F.col("n")
    return agg.select("n", "n_pos", share.alias("pos_share"), share.between(lo, hi).alias("in_range"))
