"""M2: a random forest grown level by level on all rows, with the model as a table.

Features are the binned sparse rows of ``boosting.binned_rows`` (a map from term to bin; an absent
term weighs 0, so it lies below every bin).

1. ``bagged_rows`` draws how often a row is in each tree's sample: Poisson(1) from a hash of
   (seed, tree, key), so no draw depends on partitions, order or retries.
2. ``fit`` grows all trees together. A level is one pass over the rows, dealt into tasks of a bounded number of
   entries (``cells``): Arrow batches walk the trees and add up class weights by (tree, node, term, bin), Spark
   sums them over the tasks. A node looks only at the terms its lottery picks, each with probability 1 / sqrt(number of
   terms), and they are picked before anything is shuffled. Running sums over a term's bins give the
   weighted Gini gain of every split; the best of a node is the last step of the same plan.
3. A level's nodes are written as a table. Up to ``BROADCAST_NODES`` splits (counted on the written table)
   travel to the tasks as one look-up; beyond, rows reach their node by joining the levels above on
   (tree, node). No row is sent to the driver, and none is left out.

Class weights are summed as integers (units of ``1 / SCALE``), so trees don't depend on task order.
Equal gains go to the smaller term, then the smaller bin. A node with one class only, without a
gain above ``least_gain`` or with fewer than ``2 * min_leaf`` rows is a leaf.

Rows with a null label or weight don't train. Rows without terms go left everywhere. A null key draws as an
empty one. A tree whose sample is empty has no node and no vote; without any vote (no training rows)
the probability is null. Keys are unique: rows that share one are scored together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postrisk.constants import N_TREES, SPLIT_SEED
from postrisk.operators.boosting import SCALE
from postrisk.operators.cells import Sums, dealt, slices, unpack
from postrisk.session import materialize

PRIME = (1 << 31) - 1
BROADCAST_NODES = 200_000
NODES = "tree int, node long, w0 long, w1 long, n long, term string, bin int, gain double"
MAX_COPIES = 9  # a draw of 10 or more has probability 1e-7; 32 bits hold no finer step worth a place


def poisson_steps(n: int = MAX_COPIES) -> list[int]:
    """A draw below step k (of 2**32) means at most k copies: the distribution function of Poisson(1)."""
    total, out = 0.0, []
    for k in range(n):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * (1 << 32)))
    return out


def _hex(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def _slot(term: Column) -> Column:
    """A term's number in the lottery; terms that share one are only picked together."""
    return F.pmod(_hex(term, 1, 8), F.lit(PRIME))


@dataclass(frozen=True)
class Forest:
    """``nodes``: tree, node (from 1; children 2n left, 2n + 1 right), w0, w1, n, term, bin, gain (the last three
    null in leaves). ``depth``: levels of splits."""
    nodes: DataFrame
    n_trees: int
    depth: int

    def level(self, k: int) -> DataFrame:
        return self.nodes.where((F.col("node") >= 1 << k) & (F.col("node") < 2 << k))


def load(nodes: DataFrame, n_trees: int) -> Forest:
    """The forest of a written node table."""
    top = nodes.where("term is not null").agg(F.max("node")).first()[0]
    return Forest(nodes, n_trees, top.bit_length() if top else 0)


def bagged_rows(rows: DataFrame, n_trees: int, seed: int = SPLIT_SEED, key: str = "post_id") -> DataFrame:
    """label, w, cells, bag: a row's copies in each tree."""
    draw = [F.lit(s) for s in poisson_steps()]

    def copies(tree: Column) -> Column:
        u = _hex(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), F.col(key).cast("string")), 1, 8)
        return sum((F.when(u >= s, 1).otherwise(0) for s in draw), F.lit(0))

    return rows.where(F.col("label").isNotNull() & F.col("weight").isNotNull()).select(
        F.col("label").cast("int").alias("label"), F.round(F.col("weight") * SCALE).cast("long").alias("w"), "cells",
        F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), copies).alias("bag"))


def _with_slots(bagged: DataFrame) -> DataFrame:
    """cells, slots: terms with their lottery number, and one entry without a term that carries the node's totals."""
    slots = F.transform(F.arrays_zip("_terms", "_bins"), lambda e: F.struct(e["_terms"].alias("term"), e["_bins"].alias("bin"), _slot(e["_terms"]).alias("slot")))
    whole = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("slot"))
    return bagged.withColumns({"cells": F.map_from_arrays("_terms", "_bins"), "slots": F.concat(F.array(whole), slots)})


class Lookup:
    """The splits of some levels, sorted by (tree, node)."""

    def __init__(self, splits: pa.Table):
        tree, node = (splits.column(c).to_numpy().astype(np.int64) for c in ("tree", "node"))
        order = np.lexsort((node, tree))
        self.keys, self.bin = (tree << 40 | node)[order], splits.column("bin").to_numpy().astype(np.int64)[order]
        names = splits.column("term").to_pylist()
        self.places = {t: k for k, t in enumerate(sorted(set(names)))}
        self.place = np.array([self.places[names[i]] for i in order], np.int64)

    def down(self, tree: np.ndarray, node: np.ndarray, row: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step: (is there a split, the child where there is one)."""
        key = tree << 40 | node
        if not len(self.keys):
            return np.zeros(len(key), bool), node
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, np.where(found, 2 * node + (bins[row, self.place[at]] >= self.bin[at]), node)


def _splits(levels: DataFrame) -> pa.Table:
    return levels.where("term is not null").select("tree", "node", "term", "bin").toArrow()


def _md5(text: str) -> tuple[int, int]:
    h = hashlib.md5(text.encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


class Lottery:
    """Which terms the nodes of a tree look at; numbers are kept while a task runs."""

    def __init__(self, share: float, seed: int):
        self.share, self.seed, self.slot = int(share * PRIME), seed, {}

    def picks(self, tree: int, nodes: np.ndarray, terms: list[str]) -> np.ndarray:
        for t in terms:
            if t not in self.slot:
                self.slot[t] = _md5(t)[0] % PRIME
        ab = [_md5(f"{self.seed}:{tree}:{n}") for n in nodes]
        a, b = np.array([x % (PRIME - 1) + 1 for x, _ in ab], np.int64), np.array([y % PRIME for _, y in ab], np.int64)
        slots = np.array([self.slot[t] for t in terms], np.int64)
        return (a[:, None] * slots[None] + b[:, None]) % PRIME < self.share


def task_histogram(bagged: DataFrame, splits: pa.Table, depth: int, share: float, seed: int) -> DataFrame:
    """``histogram`` of the rows at level ``depth``, walked and summed inside the tasks."""
    table = bagged.sparkSession.sparkContext.broadcast(Lookup(splits))
    names = ["tree", "node", "term", "bin", "w0", "w1", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lottery, sums = table.value, Lottery(share, seed), Sums(3)

        def lines() -> Iterator[pa.RecordBatch]:
            for g, term, b, values in sums.take():
                yield pa.RecordBatch.from_arrays([pa.array(g >> 40, pa.int32()), pa.array(g & (1 << 40) - 1), term, pa.array(b, pa.int32()),
                                                  *map(pa.array, values)], names)
        for s in slices(batches, len(known.places)):
            bag = np.array(s.column("bag").tolist(), np.int64).reshape(len(s), -1)
            bins, label, w = s.matrix(known.places), s.column("label"), s.column("w")
            row, tree = np.nonzero(bag)
            node, copies = np.ones(len(row), np.int64), bag[row, tree]
            for _ in range(depth):
                found, node = known.down(tree, node, row, bins)
                row, tree, node, copies = row[found], tree[found], node[found], copies[found]
            w0, w1 = (np.where(label[row] == y, w[row] * copies, 0).astype(np.int64) for y in (0, 1))
            one, none = np.ones(len(row), np.int64), np.full(len(row), -1)
            sums.add(tree << 40 | node, s.terms, none, np.zeros(len(row), np.int64), [w0, w1, one])
            for k in np.unique(tree) if share and s.terms else ():
                mine = np.flatnonzero(tree == k)
                nodes, at = np.unique(node[mine], return_inverse=True)
                picks = lottery.picks(int(k), nodes, s.terms)
                of_row, nth = np.full(len(s), -1), np.full(len(s), len(nodes))
                of_row[row[mine]], nth[row[mine]] = mine, at
                use = np.flatnonzero(np.vstack([picks, np.zeros((1, len(s.terms)), bool)])[nth[s.row], s.code])
                e = of_row[s.row[use]]
                sums.add(k << 40 | node[e], s.terms, s.code[use], s.bin[use], [w0[e], w1[e], one[e]])
            if sums.full:
                yield from lines()
        yield from lines()
    return bagged.mapInArrow(run, "tree int, node long, term string, bin int, w0 long, w1 long, n long") \
        .groupBy("tree", "node", "term", "bin").agg(*[F.sum(c).alias(c) for c in names[4:]])


def _down(at: DataFrame, splits: DataFrame, how: str) -> DataFrame:
    """One step from (tree, node) to the child; with ``how="left"`` rows in a leaf stay."""
    s = splits.where("term is not null").select("tree", "node", F.col("term").alias("_term"), F.col("bin").alias("_bin"))
    if splits.count() <= BROADCAST_NODES:
        s = F.broadcast(s)
    right = F.coalesce(F.element_at("cells", F.col("_term")) >= F.col("_bin"), F.lit(False)).cast("int")
    child = F.when(F.col("_term").isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node"))
    return at.join(s, ["tree", "node"], how).withColumn("node", child).drop("_term", "_bin")


def histogram(at: DataFrame, share: float, seed: int) -> DataFrame:
    """tree, node, term, bin, w0, w1, n of the terms each node's lottery picks; a null term has the node's totals."""
    node = F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string"))
    part = at.select("tree", "node", F.when(F.col("label") == 0, F.col("w") * F.col("times")).otherwise(0).alias("w0"),
                     F.when(F.col("label") == 1, F.col("w") * F.col("times")).otherwise(0).alias("w1"),
                     (F.pmod(_hex(node, 1, 8), F.lit(PRIME - 1)) + 1).alias("a"), F.pmod(_hex(node, 9, 8), F.lit(PRIME)).alias("b"), "slots")
    cell = part.select("tree", "node", "w0", "w1", "a", "b", F.inline("slots"))
    picked = F.col("term").isNull() | (F.pmod(F.col("a") * F.col("slot") + F.col("b"), F.lit(PRIME)) < int(share * PRIME))
    return cell.where(picked).groupBy("tree", "node", "term", "bin").agg(
        F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.count(F.lit(1)).alias("n"))


def best_splits(hist: DataFrame, min_leaf: int, least_gain: float) -> DataFrame:
    """tree, node, w0, w1, n, term, bin, gain of every node in the histogram. A node's lines are at most
    its picked terms times the bins, so its window is bounded by parameters."""
    here = Window.partitionBy("tree", "node")
    up = Window.partitionBy("tree", "node", "term").orderBy(F.desc("bin"))
    total = {c: F.max(F.when(F.col("term").isNull(), F.col(c))).over(here) for c in ("w0", "w1", "n")}
    s = hist.select("tree", "node", "term", "bin", *[x.alias("t" + c) for c, x in total.items()],
                    *[F.sum(c).over(up).alias("r" + c) for c in ("w0", "w1", "n")])

    def side(x0: Column, x1: Column) -> Column:
        a, b = x0 / SCALE, x1 / SCALE
        return (a * a + b * b) / (a + b)

    c = F.col
    l0, l1 = c("tw0") - c("rw0"), c("tw1") - c("rw1")
    gain = side(l0, l1) + side(c("rw0"), c("rw1")) - side(c("tw0"), c("tw1"))
    may = (c("term").isNotNull() & (c("tw0") > 0) & (c("tw1") > 0) & (c("rn") >= min_leaf) & (c("tn") - c("rn") >= min_leaf)
           & (l0 + l1 > 0) & (c("rw0") + c("rw1") > 0))
    worth = F.when(may, gain)
    choice = F.when(worth > least_gain, F.struct((-worth).alias("loss"), c("term").alias("term"), c("bin").alias("bin")))
    return s.groupBy("tree", "node").agg(F.max("tw0").alias("w0"), F.max("tw1").alias("w1"), F.max("tn").alias("n"), F.min(choice).alias("s")) \
        .select("tree", "node", "w0", "w1", "n", "s.term", "s.bin", (-F.col("s.loss")).alias("gain"))


def fit(rows: DataFrame, n_terms: int, n_trees: int = N_TREES, depth: int = 12, min_leaf: int = 1, seed: int = SPLIT_SEED,
        least_gain: float = 1e-9, key: str = "post_id") -> Forest:
    """Grow ``n_trees`` trees on rows of (key, label, weight, cells). ``n_terms`` is the size of the vocabulary."""
    bagged = dealt(unpack(bagged_rows(rows, n_trees, seed, key)), "forest-rows")
    share, nodes, reached, at, levels = 1 / math.sqrt(max(n_terms, 1)), None, 0, None, []
    for k in range(depth + 1):
        part = share if k < depth else 0.0  # the last level only needs its totals
        if at is None and nodes is not None and nodes.where("term is not null").count() > BROADCAST_NODES:
            at = _with_slots(bagged).select("label", "w", "cells", "slots", F.posexplode("bag").alias("tree", "times")).where("times > 0") \
                .withColumn("node", F.lit(1).cast("long"))
            for level in levels:
                at = _down(at, level, "inner")
        if at is not None:
            hist = histogram(at, part, seed)
        else:
            hist = task_histogram(bagged, _splits(nodes if nodes is not None else rows.sparkSession.createDataFrame([], NODES)), k, part, seed)
        level = materialize(best_splits(hist, min_leaf, least_gain), "forest-level")
        nodes = level if nodes is None else nodes.unionByName(level)
        levels.append(level)
        if level.where("term is not null").isEmpty():
            break
        reached = k + 1
        at = None if at is None else _down(at, level, "inner")
    return Forest(materialize(nodes, "forest"), n_trees, reached)


def _leaves(forest: Forest) -> DataFrame:
    return forest.nodes.where("term is null").select(
        "tree", "node", F.round(F.col("w1") / (F.col("w0") + F.col("w1")) * (1 << 30)).cast("long").alias("_p"))


def _task_votes(rows: DataFrame, forest: Forest, key: str) -> DataFrame:
    """key, _s, _n: sum and number of the trees' votes, walked inside the tasks."""
    leaf = _leaves(forest).where("_p is not null").orderBy("tree", "node").toArrow()
    keys = leaf.column("tree").to_numpy().astype(np.int64) << 40 | leaf.column("node").to_numpy()
    table = rows.sparkSession.sparkContext.broadcast((Lookup(_splits(forest.nodes)), keys, leaf.column("_p").to_numpy()))
    depth, n_trees = forest.depth, forest.n_trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, p = table.value
        for s in slices(batches, len(known.places)):
            bins = s.matrix(known.places)
            row, tree = np.repeat(np.arange(len(s)), n_trees), np.tile(np.arange(n_trees), len(s))
            node = np.ones(len(row), np.int64)
            for _ in range(depth):
                node = known.down(tree, node, row, bins)[1]
            at, end = np.searchsorted(keys, tree << 40 | node), np.append(keys, -1)
            ok = end[at] == tree << 40 | node
            vote = np.where(ok, np.append(p, 0)[at], 0).reshape(len(s), n_trees).sum(1)
            yield pa.RecordBatch.from_arrays([s.batch.column(0), pa.array(vote), pa.array(ok.reshape(len(s), n_trees).sum(1))], [key, "_s", "_n"])
    rows = unpack(rows.select(key, "cells"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, _s long, _n long")


def score(rows: DataFrame, forest: Forest, out: str = "P_hoax", key: str = "post_id") -> DataFrame:
    """key and ``out``: the mean of the trees' class-1 shares, summed as integers."""
    if forest.nodes.count() <= BROADCAST_NODES:
        votes = _task_votes(rows, forest, key).groupBy(key).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        return votes.select(key, F.when(F.col("_n") > 0, F.col("_s") / (F.col("_n") * (1 << 30))).alias(out))
    at = rows.select(key, "cells", F.explode(F.sequence(F.lit(0), F.lit(forest.n_trees - 1))).alias("tree")) \
        .withColumn("node", F.lit(1).cast("long"))
    for k in range(forest.depth):
        at = _down(at, forest.level(k), "left")
    leaf = _leaves(forest)
    votes = at.drop("cells").join(leaf, ["tree", "node"], "left").groupBy(key).agg(F.sum("_p").alias("_s"), F.count("_p").alias("_n"))
    return votes.select(key, F.when(F.col("_n") > 0, F.col("_s") / (F.col("_n") * (1 << 30))).alias(out))
