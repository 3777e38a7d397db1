"""Union, keep-first de-duplication, missing/blank filters, projection and the cleaning audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.constants import CLEAN_COLUMNS, REQUIRED_COLUMNS
from postrisk.functions.scores import amplification, coerce_count, hours_between, parse_ts, velocity
from postrisk.functions.text import clean_text, cleans_to_empty, has_content

ARRIVAL = ("source_rank", "row_ord")


#: Arrival order of tables that don't number their rows.
FALLBACK_ARRIVAL = ("scraped_at_utc", "query", "text")


def arrival_order(df: DataFrame) -> list[str]:
    """Columns that order arrivals: source and row number where the table has them, else
    source, scrape time, query and text."""
    if all(c in df.columns for c in ARRIVAL):
        return list(ARRIVAL)
    return [c for c in (*ARRIVAL, *FALLBACK_ARRIVAL) if c in df.columns]


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all in the given order; ``source_rank`` records the position."""
    out = None
    for rank, df in enumerate(dfs):
        if "source_rank" not in df.columns:
            df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def dedupe_keep_first(df: DataFrame, key: str = "post_id",
                      order_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the first in arrival order (``arrival_order`` unless given;
    remaining ties by the other columns). Null keys form one group.

    ``min_by`` over a struct is combined map-side, so a key holding a large share
    of the rows never reaches a single task in full; the result is deterministic
    (unlike ``dropDuplicates``, which keeps an arbitrary row).
    """
    cols = df.columns
    order_cols = arrival_order(df) if order_cols is None else list(order_cols)
    if list(order_cols) != list(ARRIVAL):  # not numbered: let equal arrivals differ by their content
        order_cols = [*order_cols, *[c for c in cols if c not in order_cols and c != key]]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(key).agg(first.alias("_first")).select("_first.*")


def drop_missing(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS,
                 text_col: str = "text") -> DataFrame:
    """Drop rows with a null required column or a blank text."""
    return df.na.drop(subset=list(required)).filter(has_content(text_col))


def select_output(df: DataFrame, columns: Sequence[str] = CLEAN_COLUMNS) -> DataFrame:
    """The fixed output column order."""
    return df.select(*columns)


def row_features(df: DataFrame, strip_keycaps: bool = True) -> DataFrame:
    """Row-local part of cleaning, computed before de-duplication (in the scan stage).

    Adds numeric counters, parsed timestamps, hours since post, raw
    amplification/velocity and ``_reason``: why the row would be dropped after
    de-duplication (null when kept). The text itself is left raw; whether it
    cleans to nothing is decided without the regex passes for plain text."""
    missing = (F.col("text").isNull() | F.col("timestamp_utc").isNull()
               | F.col("scraped_at_utc").isNull() | ~has_content("text"))
    # few wide projections: a chain of withColumn re-analyses the plan each time
    s1 = df.withColumns({
        "_missing": missing,
        "_empty": cleans_to_empty("text", strip_keycaps),
        "likes": coerce_count("likes"),
        "reposts": coerce_count("reposts"),
        "replies": coerce_count("replies"),
        "timestamp_utc": parse_ts("timestamp_utc"),
        "scraped_at_utc": parse_ts("scraped_at_utc"),
    })
    s2 = s1.withColumns({
        "hours_since_post": hours_between("timestamp_utc", "scraped_at_utc"),
        "amplification_raw": amplification("likes", "reposts", "replies"),
    })
    s3 = s2.withColumns({
        "velocity_raw": velocity("likes", "reposts", "replies", "hours_since_post"),
        "_reason": (F.when(F.col("_missing"), F.lit("missing_value"))
                    .when(F.col("_empty"), F.lit("empty_after_clean"))
                    .when(F.col("hours_since_post").isNull(), F.lit("bad_timestamp"))
                    .when(F.col("amplification_raw").isNull(), F.lit("bad_amplification"))),
    })
    return s3.drop("_missing", "_empty")


def kept_rows(raw: DataFrame, columns=None, strip_keycaps: bool = True,
              pre: DataFrame | None = None) -> DataFrame:
    """De-duplicated rows that survive all filters (text still raw).

    ``columns`` narrows what the de-dup carries (e.g. only the numeric features
    for statistics), so a narrow consumer never shuffles the text. ``pre`` is
    ``row_features(raw)`` when the caller already has it."""
    pre = row_features(raw, strip_keycaps) if pre is None else pre
    if columns is not None:
        keep = ["post_id", *arrival_order(pre), "_reason", *columns]
        pre = pre.select(*dict.fromkeys(keep))
    d = dedupe_keep_first(pre)
    return d.filter(F.col("_reason").isNull()).drop("_reason")


def clean_posts(raw: DataFrame, strip_keycaps: bool = True, pre: DataFrame | None = None) -> DataFrame:
    """Keep-first de-dup, missing/blank filters, text cleaning, counter
    coercion, hours since post, raw amplification and velocity (not yet scaled)."""
    return kept_rows(raw, strip_keycaps=strip_keycaps, pre=pre).withColumn(
        "text", clean_text("text", strip_keycaps))


AUDIT_STEPS = ("input", "duplicate_id", "missing_value", "empty_after_clean", "bad_timestamp",
               "bad_amplification", "output")


def cleaning_audit(raw: DataFrame, strip_keycaps: bool = True) -> DataFrame:
    """Rows in, rows dropped per reason, rows out - from one aggregate."""
    n_in = raw.select(F.count(F.lit(1))).scalar()
    pre = row_features(raw, strip_keycaps)
    narrow = pre.select("post_id", *arrival_order(pre), "_reason")
    kept = dedupe_keep_first(narrow)
    r = F.col("_reason")
    agg = kept.agg(
        F.count(F.lit(1)).alias("n_unique"),
        *[F.count_if(r == s).alias(s) for s in AUDIT_STEPS[2:6]],
        F.count_if(r.isNull()).alias("output"),
    )
    def step(i, name, rows):
        return F.struct(F.lit(i).alias("step_order"), F.lit(name).alias("step"),
                        rows.cast("long").alias("rows"))

    steps = [step(0, "input", n_in), step(1, "duplicate_id", n_in - F.col("n_unique"))]
    for i, s in enumerate(AUDIT_STEPS[2:], start=2):
        steps.append(step(i, s, F.col(s)))
    return agg.select(F.inline(F.array(*steps)))
