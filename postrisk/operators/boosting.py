"""M3: second-order boosted trees for the logistic loss, grown on histograms.

Features are sparse (key, term, weight) rows, as ``models.tfidf_table`` gives them.

1. ``term_cuts`` sketches each term's weights: row weights summed over a fixed grid of
   ``GRID`` levels (sums merge, so a hot term costs its map-side sums), cut where equal shares
   of row weight lie. A term has at most ``bins`` bins; absence is no bin.
2. ``binned_rows`` holds a row's bins as one map, so trees never shuffle rows.
3. ``fit`` grows a tree level by level. One aggregate gives gradient and curvature by
   (node, term, bin); running sums over a term's bins give every split's gain, with absent terms
   on either side; the best split of a node is one more aggregate. What a level sends to the
   driver is one line a node, so a model has at most ``rounds * 2**depth`` leaves there.
4. A level is one pass over the rows, dealt into tasks of a bounded number of entries (``cells``): Arrow
   batches walk the trees, add up their lines, and Spark sums them over the tasks. Every ``cut_every``
   rounds the margins are written with the rows, into the checkpoint folder.

Gradients are summed as integers (units of ``1 / SCALE``), so trees don't depend on task order. Equal
gains go to the smaller term, the smaller bin, absent terms to the left.

Rows without any term follow the absent side. Null labels are refused by the fit's filter: such
rows don't train. With one class only, or no rows, trees have no split worth its cost or no
leaf, and every margin stays where the leaves put it (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postrisk.constants import N_TREES
from postrisk.operators.cells import Slice, Sums, dealt, slices, unpack
from postrisk.session import materialize

GRID = 1024
SCALE = 1 << 20
BINS = 16
TREE_SCHEMA = "tree int, node int, term string, bin int, absent_right boolean, gain double, value double"


@dataclass(frozen=True)
class Split:
    """Rows whose bin of ``term`` is at least ``bin`` go right; rows without the term where ``absent_right`` says."""
    term: str
    bin: int
    absent_right: bool
    gain: float


@dataclass
class Tree:
    """Nodes are numbered from 1; the children of n are 2n (left) and 2n + 1 (right)."""
    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


def _level(weight: str) -> Column:
    # rounded first: the last digits of a weight depend on the order of its document's sum
    return F.floor(F.sqrt(F.round(F.col(weight), 9)) * GRID).cast("int")


def term_cuts(weights: DataFrame, rows: DataFrame, bins: int = BINS, key: str = "post_id") -> DataFrame:
    """term, starts: the lowest grid level of each bin, ascending. ``rows`` has key and weight."""
    w = rows.select(key, F.round(F.col("weight") * SCALE).cast("long").alias("_w"))
    sketch = (weights.select(key, "term", _level("weight").alias("_level")).join(w, key)
              .groupBy("term", "_level").agg(F.sum("_w").alias("_w")))
    by_level = Window.partitionBy("term").orderBy("_level")
    before = F.coalesce(F.sum("_w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_w").over(Window.partitionBy("term"))
    cut = sketch.select("term", "_level", before.alias("_before"), total.alias("_total"))
    share = F.expr(f"({int(bins)} * _before) div greatest(_total, 1)")
    starts = cut.groupBy("term", share.alias("_share")).agg(F.min("_level").alias("_start"))
    return starts.groupBy("term").agg(F.array_sort(F.collect_list("_start")).alias("starts"))


def binned_rows(weights: DataFrame, rows: DataFrame, cuts: DataFrame, key: str = "post_id") -> DataFrame:
    """The columns of ``rows`` and cells: a map from term to its bin (from 1). Terms without cuts are left out."""
    cells = (weights.select(key, "term", _level("weight").alias("_level")).join(cuts, "term")
             .select(key, "term", F.greatest(F.lit(1), F.size(F.filter("starts", lambda s: s <= F.col("_level")))).alias("bin")))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "bin"))).alias("cells"))
    none = F.create_map().cast("map<string,int>")
    return rows.join(maps, key, "left").withColumn("cells", F.coalesce("cells", none))


def _terms(trees: list[Tree]) -> dict[str, int]:
    """The terms the trees split on, with their places in a slice's matrix."""
    return {t: k for k, t in enumerate(sorted({s.term for tree in trees for s in tree.splits.values()}))}


def node_of(tree: Tree, bins: np.ndarray, places: dict[str, int]) -> np.ndarray:
    """The node at which each row of a matrix of bins ends so far."""
    at = np.ones(len(bins), np.int64)
    for n in sorted(tree.splits):  # a node comes after its parent
        s = tree.splits[n]
        here = np.flatnonzero(at == n)
        x = bins[here, places[s.term]]
        at[here] = 2 * n + np.where(x > 0, x >= s.bin, s.absent_right)
    return at


def margin_of(trees: list[Tree], margin: np.ndarray, bins: np.ndarray, places: dict[str, int]) -> np.ndarray:
    """``margin`` and the trees' parts of it."""
    for tree in trees:
        at = node_of(tree, bins, places)
        nodes, back = np.unique(at, return_inverse=True)
        margin = margin + np.array([float(tree.leaves.get(int(n), 0.0)) for n in nodes])[back]
    return margin


def _derivatives(s: Slice, margin: np.ndarray) -> list[np.ndarray]:
    """Gradient and curvature in units, then 1 where they are known: a null label has no gradient, a null weight neither."""
    p = 1.0 / (1.0 + np.exp(-margin))
    y, w = s.column("label").astype(np.float64), s.column("weight").astype(np.float64)

    def units(x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), 0.0, x) * SCALE
        return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)
    both = w * (p - y), w * p * (1.0 - p)
    return [*map(units, both), *[(~np.isnan(x)).astype(np.int64) for x in both]]


def _known_sums() -> list[Column]:
    """g and h of an aggregate, null where no row's is known."""
    return [F.when(F.sum(k) > 0, F.sum(c)).alias(c) for c, k in (("g", "kg"), ("h", "kh"))]


def split_gains(hist: DataFrame, totals: dict[int, tuple[int, int]], lam: float, min_child: float) -> DataFrame:
    """node, term, bin, absent_right, gain and the sides' sums (gl, hl, gr, hr), for every split whose sides both
    hold ``min_child`` curvature. ``hist`` has node, term, bin, g, h; ``totals`` the sums of each node."""
    upward = Window.partitionBy("node", "term").orderBy(F.desc("bin"))
    pairs = [x for n, (g, h) in sorted(totals.items()) for x in (F.lit(n), F.struct(F.lit(g).cast("long").alias("g"), F.lit(h).cast("long").alias("h")))]
    t = F.element_at(F.create_map(*pairs), F.col("node"))
    here = Window.partitionBy("node", "term")
    sums = hist.select("node", "term", "bin", F.sum("g").over(upward).alias("gu"), F.sum("h").over(upward).alias("hu"),
                       F.sum("g").over(here).alias("gp"), F.sum("h").over(here).alias("hp"), F.min("bin").over(here).alias("low"),
                       t["g"].alias("gt"), t["h"].alias("ht"))
    # absent left: the right side is what lies at or above the bin; absent right: the left side is what lies below it
    one = F.struct(F.lit(False).alias("absent_right"), (F.col("gt") - F.col("gu")).alias("gl"), (F.col("ht") - F.col("hu")).alias("hl"))
    two = F.struct(F.lit(True).alias("absent_right"), (F.col("gp") - F.col("gu")).alias("gl"), (F.col("hp") - F.col("hu")).alias("hl"))
    sides = F.when(F.col("bin") > F.col("low"), F.array(one, two)).otherwise(F.array(one))
    both = (sums.select("node", "term", "bin", "gt", "ht", F.inline(sides))
            .withColumn("gr", F.col("gt") - F.col("gl")).withColumn("hr", F.col("ht") - F.col("hl")))

    def worth(g: str, h: str) -> Column:
        return (F.col(g) / SCALE) * (F.col(g) / SCALE) / (F.col(h) / SCALE + lam)

    gain = (worth("gl", "hl") + worth("gr", "hr") - worth("gt", "ht")) / 2
    least = round(min_child * SCALE)
    return both.where((F.col("hl") >= least) & (F.col("hr") >= least)).select(
        "node", "term", "bin", "absent_right", gain.alias("gain"), "gl", "hl", "gr", "hr")


def histogram(rows: DataFrame, tree: Tree, open_nodes: list[int], since: list[Tree]) -> DataFrame:
    """node, term, bin, g, h over the rows in ``open_nodes``, at their margin with the trees ``since``."""
    places, nodes = _terms([tree, *since]), np.array(open_nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(4)

        def lines() -> Iterator[pa.RecordBatch]:
            for n, term, b, values in sums.take():
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), term, pa.array(b, pa.int32()), *map(pa.array, values)],
                                                 ["node", "term", "bin", "g", "h", "kg", "kh"])
        for s in slices(batches, len(places)):
            bins = s.matrix(places)
            d = _derivatives(s, margin_of(since, s.column("margin"), bins, places))
            at = node_of(tree, bins, places)
            use = np.isin(at, nodes)[s.row]
            row = s.row[use]
            sums.add(at[row], s.terms, s.code[use], s.bin[use], [x[row] for x in d])
            if sums.full:
                yield from lines()
        yield from lines()
    return (rows.select("label", "weight", "margin", "_terms", "_bins").mapInArrow(run, "node int, term string, bin int, g long, h long, kg long, kh long")
            .groupBy("node", "term", "bin").agg(*_known_sums()))


def totals_of(rows: DataFrame, since: list[Tree]) -> tuple[int | None, int | None]:
    """Sums of gradient and curvature over all rows; nulls without rows."""
    places = _terms(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, len(places)):
            d = _derivatives(s, margin_of(since, s.column("margin"), s.matrix(places), places))
            yield pa.RecordBatch.from_arrays([pa.array([x.sum()]) for x in d], ["g", "h", "kg", "kh"])
    return tuple(rows.select("label", "weight", "margin", "_terms", "_bins").mapInArrow(run, "g long, h long, kg long, kh long")
                 .agg(*_known_sums()).first())


def root_gains(rows: DataFrame, lam: float = 1.0, min_child: float = 1.0) -> DataFrame:
    """term, bin, absent_right, gain: every term's best first split."""
    rows = unpack(rows).withColumn("margin", F.lit(0.0))
    g, h = totals_of(rows, [])
    if g is None:
        return rows.sparkSession.createDataFrame([], "term string, bin int, absent_right boolean, gain double")
    gains = split_gains(histogram(rows, Tree(), [1], []), {1: (g, h)}, lam, min_child)
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "bin", "absent_right")).alias("b")
    return gains.groupBy("term").agg(best).select("term", "b.bin", "b.absent_right", (-F.col("b.loss")).alias("gain"))


def with_margin(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """The unpacked rows with the trees' parts added to ``margin``."""
    places = _terms(trees)
    fields = [f for f in rows.schema.fields if f.name != "margin"]
    schema = StructType([*fields, StructField("margin", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, len(places)):
            m = margin_of(trees, s.column("margin"), s.matrix(places), places)
            kept = [s.batch.column(s.batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(m, pa.float64())], [*[f.name for f in fields], "margin"])
    return rows.mapInArrow(run, schema)


def grow(rows: DataFrame, since: list[Tree], depth: int, eta: float, lam: float, gamma: float, min_child: float) -> Tree:
    """One tree on the derivatives at the margin with the trees ``since``."""
    tree = Tree()
    first = totals_of(rows, since)
    if first[0] is None:
        return tree
    totals = {1: (first[0], first[1])}
    for level in range(depth + 1):
        best = {}
        if level < depth and totals:
            gains = split_gains(histogram(rows, tree, sorted(totals), since), totals, lam, min_child).where(F.col("gain") > gamma)
            order = F.struct((-F.col("gain")).alias("loss"), "term", "bin", "absent_right", "gl", "hl", "gr", "hr")
            best = {r.node: r.best for r in gains.groupBy("node").agg(F.min(order).alias("best")).collect()}  # a line a node
        after = {}
        for n, (g, h) in totals.items():
            b = best.get(n)
            if b is None:
                tree.leaves[n] = -eta * (g / SCALE) / (h / SCALE + lam)
                continue
            tree.splits[n] = Split(b.term, b.bin, b.absent_right, -b.loss)
            after[2 * n], after[2 * n + 1] = (b.gl, b.hl), (b.gr, b.hr)
        totals = after
        if not totals:
            break
    return tree


def fit(rows: DataFrame, rounds: int = N_TREES, depth: int = 6, eta: float = 0.3, lam: float = 1.0, gamma: float = 0.0,
        min_child: float = 1.0, cut_every: int = 10) -> list[Tree]:
    """Boost ``rounds`` trees on rows of (label, weight, cells); all rows take part in every tree."""
    rows = rows.where(F.col("label").isNotNull() & F.col("weight").isNotNull()).select("label", "weight", "cells", F.lit(0.0).alias("margin"))
    rows = dealt(unpack(rows), "boost-rows")
    trees: list[Tree] = []
    since: list[Tree] = []  # trees that the stored margin lacks
    for _ in range(rounds):
        tree = grow(rows, since, depth, eta, lam, gamma, min_child)
        since.append(tree)
        trees.append(tree)
        if len(since) == cut_every and len(trees) < rounds:
            rows = materialize(with_margin(rows, since), "boost-rows")
            since = []
    return trees


def score(rows: DataFrame, trees: list[Tree], out: str = "P_hoax", step: int = 10) -> DataFrame:
    """The rows without cells, with the class-1 probability as ``out``; ``step`` trees are walked at a time."""
    done = unpack(rows).withColumn("margin", F.lit(0.0))
    for k in range(0, len(trees), step):
        done = with_margin(done, trees[k:k + step])
    return done.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).drop("_terms", "_bins", "margin")


def tree_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """The model as rows: splits with their gain, leaves with their value."""
    lines = [(k, n, s.term, s.bin, s.absent_right, s.gain, None) for k, t in enumerate(trees) for n, s in t.splits.items()]
    lines += [(k, n, None, None, None, None, v) for k, t in enumerate(trees) for n, v in t.leaves.items()]
    return spark.createDataFrame(sorted(lines, key=lambda x: x[:2]), TREE_SCHEMA)


def trees_from(table: DataFrame) -> list[Tree]:
    """The model that ``tree_table`` wrote (as long as its leaves, which the fit bounds)."""
    out: dict[int, Tree] = {}
    for r in table.collect():
        t = out.setdefault(r.tree, Tree())
        if r.term is None:
            t.leaves[r.node] = r.value
        else:
            t.splits[r.node] = Split(r.term, r.bin, r.absent_right, r.gain)
    return [out[k] for k in sorted(out)]
