"""Operator 3: benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window). A document contains a window only if it has all
its shingles (runs of up to ``shingle`` words), so with the shingles ordered by
rarity over all documents the rarest one alone is the necessary prefix:

1. one pass counts how often each benchmark shingle occurs in the documents;
2. each window keeps its rarest shingle (ties: lowest hash) and the place it has
   in the window, the positional bound;
3. a second pass emits, for every place where a document has a prefix shingle,
   the words that a window around it could cover;
4. these join the prefixes by hash, salted by document. The positional bound
   gives the only place where the window can start, the length bound discards
   windows that would stick out of the document, and the words themselves are
   compared.

Before the shuffles a filter of fixed size (see ``fixed_filter``) holds back the
shingles that no benchmark item has. Rows are told apart by id and text hash.

Defined results: null or empty texts have no words, no hits and the digest of the
empty string; items without words match nothing; repeated items each count as
items; repeated documents are judged alike and all returned; an empty benchmark
leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postrisk.llm.common import LOWER, Words, byte_table, chunks, fixed_filter, grams, may_contain, prefix_hash, \
    span_hash, write_cut

IS_GAP = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WINDOW, SHINGLE, SALTS = 10, 4, 8


def _widths(window: int, shingle: int) -> range:
    """Shingle widths in use: short windows have shorter shingles."""
    return range(1, min(window, shingle) + 1)


def _scan(texts: pa.Array, widths) -> Iterator[tuple]:
    """Per chunk: rows, lower-cased bytes, words, and by width the shingle hashes with their validity."""
    for i, j, data, offs in chunks(texts):
        data = LOWER[data]
        w = Words(data, offs, IS_GAP)
        h = span_hash(prefix_hash(data), w.starts, w.ends)
        shingles = []
        for k in widths:
            g, inside = grams(h, w.row, k)
            shingles.append((k, g * np.uint64(2 * k + 1), inside))
        yield i, j, data, w, shingles


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                      id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words (joined by one space), size, and every shingle of it: hash g at place o."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            ids = b.column(0).to_pylist()
            for i, _, data, w, shingles in _scan(b.column(1), _widths(window, shingle)):
                by_width = {k: g.view(np.int64) for k, g, _ in shingles}
                tokens = [data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
                for r, n in enumerate(w.counts):
                    if not n:
                        continue
                    first, size = w.bounds[r], min(window, n)
                    k = min(size, shingle)
                    for s in range(first, first + n - size + 1):
                        text = " ".join(tokens[s:s + size])
                        for o in range(size - k + 1):
                            for col, v in zip(out, (ids[i + r], text, size, int(by_width[k][s + o]), o)):
                                col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], ["item_id", "words", "size", "g", "o"])
    return benchmark.select(id_col, text_col).mapInArrow(
        cut, f"item_id {kind}, words string, size int, g long, o int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    windows = write_cut(benchmark_windows(benchmark, window, shingle, item_col, item_text_col), "decon-windows")
    # windows of equal words are one record; its items are attached at the end
    distinct = windows.select("words", "size", "g", "o").distinct()
    every = spark.sparkContext.broadcast(fixed_filter(windows.select("g").distinct(), "g"))
    widths = sorted({min(r["size"], shingle) for r in windows.select("size").distinct().collect()})  # at most `window` rows

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = every.value
        for b in batches:
            for *_, shingles in _scan(b.column(0), widths):
                for _, g, inside in shingles:
                    got, n = np.unique(g[inside & may_contain(known, g)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])
    counts = docs.select(text_col).mapInArrow(tally, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    ranked = distinct.join(counts, "g", "left").withColumn(
        "rn", F.row_number().over(W.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "g", "o")))
    # a window whose rarest shingle is in no document is in none either
    prefixes = write_cut(ranked.where((F.col("rn") == 1) & F.col("n").isNotNull()).select("words", "size", "g", "o"),
                         "decon-prefixes")
    wanted = spark.sparkContext.broadcast(fixed_filter(prefixes.select("g").distinct(), "g"))

    places = pa.list_(pa.struct([("g", pa.int64()), ("pos", pa.int64()), ("around", pa.string()), ("at", pa.int32())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for b in batches:
            for i, j, data, w, shingles in _scan(b.column(1), widths):
                found: list[list] = [[] for _ in range(j - i)]
                for _, g, inside in shingles:
                    for p in np.flatnonzero(inside & may_contain(known, g)):
                        r = w.row[p]
                        lo, hi = max(w.bounds[r], p - window + 1), min(w.bounds[r + 1], p + window)
                        found[r].append({
                            "g": int(g[p:p + 1].view(np.int64)[0]), "pos": int(p - w.bounds[r]), "at": int(p - lo),
                            "around": " ".join(data[w.starts[q]:w.ends[q]].tobytes().decode() for q in range(lo, hi))})
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(w.counts.astype(np.int64)),
                     pa.array(found, places)], ["id", "text_hash", "n_words", "places"])
    keyed = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_hash"))
    scanned = write_cut(keyed.mapInArrow(
        probe, f"id {kind}, text_hash long, n_words long, "
               "places array<struct<g:bigint,pos:bigint,around:string,at:int>>"), "decon-places")

    salt = F.pmod(F.xxhash64("id", "text_hash", "pos"), F.lit(SALTS)).cast("int")
    left = (scanned.where(F.size("places") > 0).select("id", "text_hash", "n_words", F.explode("places").alias("p"))
            .select("id", "text_hash", "n_words", "p.*").withColumn("salt", salt))
    right = prefixes.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    start = F.col("pos") - F.col("o")
    same = F.array_join(F.slice(F.split("around", " "), F.col("at") - F.col("o") + 1, F.col("size")), " ") == F.col("words")
    hits = (left.join(right, ["g", "salt"])
            .where((start >= 0) & (start + F.col("size") <= F.col("n_words"))).where(same)
            .select("id", "text_hash", start.alias("start"), "size", "words").distinct())
    hits = write_cut(hits, "decon-hits")
    # words covered by the union of the windows, each counted by the first window that reaches it
    order = W.partitionBy("id", "text_hash").orderBy("start", "size", "words")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    n_hit = hits.withColumn("fresh", fresh).groupBy("id", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    items = (hits.select("id", "text_hash", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
             .groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    found = _join(n_hit, items, "left")
    out = _join(scanned.select("id", "text_hash", "n_words"), found, "left")
    n_hit_col = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit_col.alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit_col > 0).alias("contaminated"))


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (id, text_hash); null ids meet null ids."""
    b = b.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    return a.join(b, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), how) \
        .drop("__id", "__hash")
