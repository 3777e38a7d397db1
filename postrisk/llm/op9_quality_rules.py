"""Operator 9: quality rules with a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one long whose bit k is set when rule k fails. A policy is a named, versioned
set of rules, i.e. a mask: applying one is ``bits & mask == 0``, and ablations
are one aggregate over the bits, with no second look at any text.

Defined results: a null or empty text has no words and fails ``few_words``;
ties and repeated rows are judged alike; an empty table gives an empty ledger;
only the id and the text column are read, so clashing extra columns don't matter.
Words and lines are compared by 64-bit hashes of their bytes inside one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import IS_BLANK, Words, byte_table, chunks, covered, grams, per_row, prefix_hash, \
    seen_before, span_hash, within_rows

IS_SYMBOL = byte_table("#*$%&|<>")
IS_LINE_END = byte_table("\n")
IS_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
IS_LETTER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_letter_bytes")


#: (name, when it fails) in bit order. Never reorder, only append: stored bits keep their meaning.
_RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("upper_case", "100 * n_upper > 60 * n_letter_bytes"),
]
RULES = [name for name, _ in _RULES]
#: Versioned policies; "base" is what every other one contains.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "long_words"),
    "v2": ("few_words", "repeated_words", "symbols", "long_words", "repeated_lines", "upper_case"),
}


def policy_mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line: a row with k line ends has k + 1 lines."""
    breaks = np.flatnonzero(IS_LINE_END[data])
    owner = np.searchsorted(offs, breaks, "right") - 1
    rows = np.arange(len(offs) - 1)
    row = np.repeat(rows, np.bincount(owner, minlength=len(rows)) + 1)
    # sorting by (row, place) keeps an empty line apart from the row that starts at the same byte
    by_start = np.lexsort((np.concatenate([offs[:-1], breaks + 1]), np.concatenate([rows, owner])))
    by_end = np.lexsort((np.concatenate([offs[1:], breaks]), np.concatenate([rows, owner])))
    return np.concatenate([offs[:-1], breaks + 1])[by_start], np.concatenate([offs[1:], breaks])[by_end], row


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in chunks(batch.column(1)):
            w = Words(data, offs, IS_BLANK)
            prefix = prefix_hash(data)
            g, inside = grams(span_hash(prefix, w.starts, w.ends), w.row, 3)
            at = np.flatnonzero(inside)
            _, twice = seen_before(within_rows(g[at], w.row[at]))
            repeat = covered(at[twice], 3, len(w))
            starts, tail, row = line_spans(data, offs)
            n_in = np.searchsorted(w.starts, tail) - np.searchsorted(w.starts, starts)
            lines = np.flatnonzero(n_in > 0)
            earlier, _ = seen_before(within_rows(span_hash(prefix, starts[lines], tail[lines]), row[lines]))
            n = len(offs) - 1
            cols = {
                "n_words": w.counts,
                "word_chars": per_row(w.mask & ((data & 0xC0) != 0x80), offs),
                "n_symbols": per_row(IS_SYMBOL[data], offs),
                "n_dup_lines": np.bincount(row[lines][earlier], minlength=n),
                "n_repeat_words": per_row(repeat, w.bounds),
                "n_lines": np.bincount(row[lines], minlength=n),
                "n_upper": per_row(IS_UPPER[data], offs),
                "n_letter_bytes": per_row(IS_LETTER[data], offs),
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *[pa.array(cols[m].astype(np.int64)) for m in MEASURES]],
                [batch.schema.names[0], *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``bits``: bit k is set when rule k of RULES fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(id_col, text_col).mapInArrow(
        measure, ", ".join([f"`{id_col}` {kind}", *[f"{m} long" for m in MEASURES]]))
    bits = " | ".join(f"if({fails}, {1 << k}L, 0L)" for k, (_, fails) in enumerate(_RULES))
    return measured.withColumn("bits", F.expr(bits))


def passes(policy: str, bits: Column | None = None) -> Column:
    bits = F.col("bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per rule of a policy: documents failing it, failing nothing else, kept without it.

    Everything comes from one aggregate over distinct masks (at most 2**rules of
    them), so the work after the ledger doesn't depend on the texts."""
    mask = policy_mask(policy)
    masks = book.groupBy(F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                               for r in POLICIES[policy]])).alias("r")
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("m").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("r.bit"))) == 0
    return (masks.select("m", "n", rows).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
            .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
                 F.coalesce(F.sum(F.when(hit & rest, F.col("n"))), F.lit(0)).alias("n_only_this"),
                 F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)).alias("n_kept_without"))
            .withColumn("policy", F.lit(policy)))
