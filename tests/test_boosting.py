"""Boosted trees on histograms against a plain version, over sparse rows."""

import math
import random

from pyspark.sql import functions as F

from postrisk.operators import boosting as b


def _plain_cuts(cells, weight, bins):
    by = {}
    for key, term, x in cells:
        level = math.floor(math.sqrt(round(x, 9)) * b.GRID)
        by.setdefault(term, {}).setdefault(level, 0)
        by[term][level] += round(weight[key] * b.SCALE)
    out = {}
    for term, levels in by.items():
        total, before, first = sum(levels.values()), 0, {}
        for level in sorted(levels):
            first.setdefault(bins * before // max(total, 1), level)
            before += levels[level]
        out[term] = sorted(first.values())
    return out


def _plain_fit(rows, rounds, depth, eta, lam, gamma, least):
    """rows: (label, weight, {term: bin}); trees as nested tuples (split) or numbers (leaf)."""
    margin = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        g, h = [], []
        for (y, w, _), m in zip(rows, margin):
            p = 1 / (1 + math.exp(-m))
            half = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
            g.append(half(w * (p - y) * b.SCALE))
            h.append(half(w * p * (1 - p) * b.SCALE))

        def worth(ids):
            return (sum(g[i] for i in ids) / b.SCALE) ** 2 / (sum(h[i] for i in ids) / b.SCALE + lam)

        def node(ids, level):
            best = None
            for term in sorted({t for i in ids for t in rows[i][2]}) if level < depth else ():
                for at in sorted({rows[i][2][term] for i in ids if term in rows[i][2]}):
                    for absent in (False, True):
                        right = [i for i in ids if (rows[i][2][term] >= at if term in rows[i][2] else absent)]
                        left = sorted(set(ids) - set(right))
                        if min(sum(h[i] for i in s) for s in (left, right)) < least * b.SCALE:
                            continue
                        gain = (worth(left) + worth(right) - worth(ids)) / 2
                        if gain > gamma and (best is None or gain > best[0] + 1e-12):
                            best = (gain, term, at, absent, left, right)
            if best is None:
                v = -eta * (sum(g[i] for i in ids) / b.SCALE) / (sum(h[i] for i in ids) / b.SCALE + lam)
                for i in ids:
                    margin[i] += v
                return v
            return (best[1:4], node(best[4], level + 1), node(best[5], level + 1))
        trees.append(node(list(range(len(rows))), 0))
    return trees, margin


def _nested(tree, n=1):
    s = tree.splits.get(n)
    return tree.leaves[n] if s is None else ((s.term, s.bin, s.absent_right), _nested(tree, 2 * n), _nested(tree, 2 * n + 1))


def _same(x, y):
    if isinstance(x, tuple) and isinstance(y, tuple):
        return x[0] == y[0] and _same(x[1], y[1]) and _same(x[2], y[2])
    return not isinstance(x, tuple) and not isinstance(y, tuple) and abs(x - y) < 1e-9


def _data(n=80):
    r = random.Random(3)
    cells, labels, weight = [], {}, {}
    for k in range(n):
        key = f"p{k}"
        labels[key], weight[key] = int(r.random() < 0.4), 1.0
        weight[key] = 1.7 if labels[key] else 1.0
        for term in ("alpha", "beta", "gamma", "delta", "hot"):
            if term == "hot" or r.random() < 0.5:
                lift = 0.35 if labels[key] and term in ("beta", "hot") else 0.0
                cells.append((key, term, round(min(1.0, r.random() * 0.6 + lift + 0.01), 3)))
    return cells, labels, weight


def _tables(spark, cells, labels, weight):
    return (spark.createDataFrame(cells, "post_id string, term string, weight double"),
            spark.createDataFrame([(k, labels[k], weight[k]) for k in labels], "post_id string, label int, weight double"))


def test_trees_equal_the_plain_version(spark):
    cells, labels, weight = _data()
    w, rows = _tables(spark, cells, labels, weight)
    cuts = b.term_cuts(w, rows, bins=5)
    want_cuts = _plain_cuts(cells, weight, 5)
    assert {r.term: r.starts for r in cuts.collect()} == want_cuts
    binned = b.binned_rows(w, rows, cuts).persist()
    bins = {k: {} for k in labels}
    for key, term, x in cells:
        level = math.floor(math.sqrt(x) * b.GRID)
        bins[key][term] = max(1, sum(s <= level for s in want_cuts[term]))
    assert {r.post_id: r.cells for r in binned.collect()} == bins
    trees = b.fit(binned, rounds=4, depth=3, cut_every=3)
    plain, margin = _plain_fit([(labels[k], weight[k], bins[k]) for k in labels], 4, 3, 0.3, 1.0, 0.0, 1.0)
    assert len(trees) == 4 and all(_same(_nested(t), p) for t, p in zip(trees, plain))
    assert any(t.splits for t in trees)
    got = {r.post_id: r.P_hoax for r in b.score(binned, trees, step=2).collect()}
    assert all(abs(got[k] - 1 / (1 + math.exp(-m))) < 1e-9 for k, m in zip(labels, margin))
    again = b.trees_from(b.tree_table(spark, trees))
    assert again == trees
    assert b.fit(binned.repartition(7), rounds=4, depth=3, cut_every=1) == trees


def test_odd_rows(spark):
    cells, labels, weight = _data(12)
    w, rows = _tables(spark, cells, labels, weight)
    cuts = b.term_cuts(w, rows)
    bare = b.binned_rows(w.where("false"), rows, cuts)
    assert bare.where(F.size("cells") == 0).count() == 12
    t, = b.fit(bare, rounds=1)
    assert not t.splits and list(t.leaves) == [1]
    empty = b.binned_rows(w, rows.where("false"), cuts)
    assert b.fit(empty, rounds=2) == [b.Tree(), b.Tree()] and b.score(empty, b.fit(empty, rounds=1)).count() == 0
    one = b.binned_rows(w, rows.withColumn("label", F.lit(1)), cuts)
    assert all(r.P_hoax > 0.5 for r in b.score(one, b.fit(one, rounds=3, depth=2)).collect())
    nulls = b.binned_rows(w, rows.withColumn("label", F.lit(None).cast("int")), cuts)
    assert b.fit(nulls, rounds=1) == [b.Tree()]
