"""Operator 8: mixing sources to target weights by entropy balancing.

Sizes are words per document. Sources in code point order (null last) weigh
5, 2, 1, repeating, and share 100 % of all words; no target exceeds ``max_copies``
times its source, the excess goes to the others by weight.

Each document gets a rate r = min(max_copies, exp(lambda_s * size / scale_s)): the
rates nearest in relative entropy to one copy each whose words meet the
source's target. The dual is convex; its token constraints separate by source, so
one Newton iteration for all sources is one Spark aggregate over the distinct
(source, size) pairs, guarded by a bracket. Iterations stop when every source is
met to ``tolerance`` or after ``iterations``; what is left goes into the rounding.
Sums are decimals, so they don't depend on the order of tasks.

Rates become copies by error diffusion in blocks: a source is dealt into blocks
of about ``block_rows`` documents, a block visits its documents from long to short
and carries the rounding error on, so a block ends within about half its shortest
document of its share. Blocks are dealt by a hash of id, text and row key. Rows alike
in all of these are first counted, and the count is cut into parts of an eighth of
``block_rows``, each dealt on its own: neither a source nor an id (or null) nor
a repeated row is ever in one task.

Defined results: null and empty texts have size 0 and take nothing; a null
source is a source of its own, last in order; a source without words has target
0; repeated rows and ties get results by (size, id), alike on every run; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postrisk.llm.common import write_cut

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          row_col: str | None = None) -> DataFrame:
    """id, source, size: the words of each whole text, a hash of the text, and with ``row_col`` that column as row."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = [F.xxhash64(text_col).alias("tie"), *([F.col(row_col).cast("long").alias("row")] if row_col else [])]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), *own)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """source, source_size, n_docs, max_size, target.

    Water-filling in closed form over the sources (a table as long as the number
    of sources): sorted by the level at which a source reaches its cap, the capped
    ones are a prefix, and the others share the rest by weight."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"),
                                     F.max("size").alias("max_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    cap = F.lit(max_copies) * F.col("source_size")
    # capped sources come before this one when their level is lower
    level = W.orderBy(F.col("level"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(W.unboundedPreceding, -1)
    onward = level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = by.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    x = (x.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("taken_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(onward))
         .withColumn("share", (F.col("total") - F.col("taken_before")) / F.col("weight_left"))
         .withColumn("capped", F.col("share") >= F.col("level")))
    # the level of the uncapped sources is the first share that is below its own cap level
    x = x.withColumn("water", F.min(F.when(~F.col("capped"), F.struct("level", "source", "share"))).over(everything)["share"])
    target = F.when(F.col("capped") | F.col("water").isNull(), F.col("cap").cast("double")) \
        .otherwise(F.col("water") * F.col("weight"))
    return x.select("source", "source_size", "n_docs", "max_size", target.alias("target"))


def _exact_sum(x: Column) -> Column:
    """A sum that is alike whatever the order of its terms."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def solve_dual(hist: DataFrame, goal: DataFrame, max_copies: int, iterations: int, tolerance: float) -> DataFrame:
    """source, lam: Newton on sum n * min(cap, exp(lam * z)) = target with z = size / max_size.

    ``hist`` has source, size, n_docs. Every iteration aggregates value and slope
    by source on the executors; the state is a table of one row per source in
    the checkpoint folder."""
    log_cap = float(np.log(max_copies))
    z = F.col("size") / F.col("max_size")
    rate = F.least(F.lit(float(max_copies)), F.exp(F.least(F.col("lam") * z, F.lit(log_cap))))
    words = F.col("size") * F.col("n")
    full = F.col("target") >= F.col("cap") * (1 - 1e-12)
    state = goal.where("source_size > 0").select(
        "source", "target", "max_size", (F.col("source_size") * max_copies).alias("cap"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(False).alias("done"))
    state = write_cut(state, "mix-dual")
    for _ in range(iterations):
        at = hist.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))) \
            .select("s.*", "h.size", "h.n")
        got = at.groupBy("source").agg(
            _exact_sum(words * rate).alias("value"),
            _exact_sum(F.when(rate < max_copies, words * rate * z).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("target", "max_size", "cap", "lam", "lo", "hi")])
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.coalesce(F.col("lo"), step - 1)) & (step < F.coalesce(F.col("hi"), step + 1))
        middle = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2) \
            .when(gap < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        done = (F.abs(gap) <= tolerance * F.col("target")) | full
        state = write_cut(
            got.withColumn("lo", lo).withColumn("hi", hi).withColumn("done", done)
            .withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise(middle))
            .select("source", "target", "max_size", "cap", "lam", "lo", "hi", "done"), "mix-dual")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", F.when(full, F.lit(1e9)).otherwise(F.col("lam")).alias("lam"))


def round_block(block: pd.DataFrame) -> pd.DataFrame:
    """Copies of one block: long documents first, each carries the words still owed to the next. A line
    of n rows alike gives n rows."""
    own = [c for c in ("row",) if c in block]
    keys = ["size", "doc_id", "tie", *own]
    block = block.loc[block.index.repeat(block["n"])].sort_values(keys, ascending=[False] + [True] * (len(keys) - 1), kind="stable")
    owed, copies = 0.0, []
    for size, rate, most in zip(block["size"], block["rate"], block["most"]):
        owed += size * rate
        c = 0 if size == 0 else int(min(most, max(0, np.floor(owed / size + 0.5))))
        owed -= c * size
        copies.append(c)
    return block.assign(copies=np.array(copies, np.int64))[["doc_id", "source", "size", "copies", *own]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3, block_rows: int = 256,
        iterations: int = 40, tolerance: float = 1e-6, **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken = copies * size.

    With ``row_col``, a long that tells rows apart, also row: the key of each row's own copies."""
    own = ["row"] if columns.get("row_col") else []
    kind = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()
    sized = write_cut(sizes(docs, **columns), "mix-sizes")
    goal = write_cut(targets(sized, weights, max_copies), "mix-targets")
    hist = write_cut(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes-hist")
    dual = solve_dual(hist, goal, max_copies, iterations, tolerance)
    goal = goal.alias("g").join(dual.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left") \
        .select("g.*", F.coalesce("d.lam", F.lit(0.0)).alias("lam"))
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(
        F.lit(float(max_copies)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("max_size"), F.lit(5.0)))))
    blocks = F.ceil(F.col("n_docs") / block_rows)
    if own:  # every row has its own key
        dealt = sized.select("*", F.lit(1).alias("n"), F.lit(0).alias("part"))
    else:
        alike = sized.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows"))
        most = max(1, block_rows // 8)
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / most)))
        dealt = alike.select("*", part.alias("part")).withColumn(
            "n", F.least(F.lit(most), F.col("rows") - F.col("part") * most).cast("int")).drop("rows")
    rated = (dealt.alias("x").join(goal.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source")))
             .select("x.*", rate.alias("rate"), F.lit(max_copies).alias("most"),
                     F.pmod(F.xxhash64("x.doc_id", "x.tie", "x.part", *own, F.lit("block")), blocks).alias("block")))
    done = rated.groupBy("source", "block").applyInPandas(
        round_block, f"doc_id {kind}, source string, size long, copies long" + ", row long" * len(own))
    return (done.alias("x").join(goal.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source")))
            .select("x.doc_id", "x.source", "x.size", "g.source_size", "g.target", "x.copies",
                    (F.col("x.copies") * F.col("x.size")).alias("taken"), *[f"x.{c}" for c in own]))
