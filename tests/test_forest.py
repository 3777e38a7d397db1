"""The level-wise forest against a plain version that grows each tree by itself."""

import hashlib
import math
import random

from postrisk.operators import boosting as b
from postrisk.operators import forest as f
from tests.test_boosting import _data, _tables

SEED = 7


def _number(text, start=0):
    return int(hashlib.md5(text.encode()).hexdigest()[start:start + 8], 16)


def _plain(rows, n_terms, n_trees, depth, min_leaf):
    """rows: {key: (label, weight units, {term: bin})}; (tree, node) -> (w0, w1, n, term, bin)."""
    share, out = int(1 / math.sqrt(n_terms) * f.PRIME), {}

    def gini(ids):
        x = [sum(rows[k][1] * c for k, c in ids if rows[k][0] == y) / f.SCALE for y in (0, 1)]
        return (x[0] * x[0] + x[1] * x[1]) / (x[0] + x[1])

    def grow(tree, node, ids, level):
        w = [sum(rows[k][1] * c for k, c in ids if rows[k][0] == y) for y in (0, 1)]
        a, c0 = _number(f"{SEED}:{tree}:{node}") % (f.PRIME - 1) + 1, _number(f"{SEED}:{tree}:{node}", 8) % f.PRIME
        best = None
        terms = sorted({t for k, _ in ids for t in rows[k][2]}) if level < depth and min(w) > 0 else ()
        for t in terms:
            if (a * (_number(t) % f.PRIME) + c0) % f.PRIME >= share:
                continue
            for at in sorted({rows[k][2][t] for k, _ in ids if t in rows[k][2]}):
                right = [(k, c) for k, c in ids if rows[k][2].get(t, 0) >= at]
                left = [(k, c) for k, c in ids if rows[k][2].get(t, 0) < at]
                if min(len(left), len(right)) < min_leaf:
                    continue
                gain = gini(left) + gini(right) - gini(ids)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, t, at, left, right)
        out[tree, node] = (w[0], w[1], len(ids), *(best[1:3] if best else (None, None)))
        if best:
            grow(tree, 2 * node, best[3], level + 1)
            grow(tree, 2 * node + 1, best[4], level + 1)

    for tree in range(n_trees):
        ids = [(k, n) for k in sorted(rows) if (n := sum(_number(f"{SEED}:{tree}:{k}") >= s for s in f.poisson_steps()))]
        if ids:
            grow(tree, 1, ids, 0)
    return out


def _walk(nodes, tree, cells):
    node = 1
    while (at := nodes[tree, node])[3] is not None:
        node = 2 * node + (cells.get(at[3], 0) >= at[4])
    return at[1] / (at[0] + at[1])


def _binned(spark, n=80):
    cells, labels, weight = _data(n)
    w, rows = _tables(spark, cells, labels, weight)
    return b.binned_rows(w, rows, b.term_cuts(w, rows, bins=5)).persist()


def _table(forest):
    return {(r.tree, r.node): (r.w0, r.w1, r.n, r.term, r.bin) for r in forest.nodes.collect()}


def test_forest_equals_the_plain_version(spark):
    rows = _binned(spark)
    plain = {r.post_id: (r.label, round(r.weight * f.SCALE), r.cells) for r in rows.collect()}
    for least, limit in ((1, f.BROADCAST_NODES), (4, 0)):
        old, f.BROADCAST_NODES = f.BROADCAST_NODES, limit  # 0: the joins beyond the broadcast bound
        try:
            grown = f.fit(rows.repartition(5), n_terms=2, n_trees=6, depth=4, min_leaf=least, seed=SEED)
            want = _plain(plain, 2, 6, 4, least)
            assert _table(grown) == want and any(x[3] for x in want.values())
            got = {r.post_id: r.P_hoax for r in f.score(rows, f.load(grown.nodes, 6)).collect()}
        finally:
            f.BROADCAST_NODES = old
        trees = sorted({t for t, _ in want})
        for k, (_, _, cells) in plain.items():
            assert abs(got[k] - sum(_walk(want, t, cells) for t in trees) / len(trees)) < 1e-8
        assert f.load(grown.nodes, 6).depth == grown.depth


def test_draws_follow_poisson():
    r, steps = random.Random(1), f.poisson_steps()
    draws = [sum(u >= s for s in steps) for u in (r.getrandbits(32) for _ in range(20000))]
    assert abs(sum(draws) / len(draws) - 1) < 0.03 and abs(draws.count(0) / len(draws) - math.exp(-1)) < 0.02


def test_odd_rows(spark):
    rows = _binned(spark, 12)
    none = f.fit(rows.where("false"), 5, n_trees=2, depth=3)
    assert none.nodes.count() == 0 and {r.P_hoax for r in f.score(rows, none).collect()} == {None}
    assert f.fit(rows.selectExpr("post_id", "cast(null as int) as label", "weight", "cells"), 5, n_trees=2).nodes.count() == 0
    one = f.fit(rows.selectExpr("post_id", "1 as label", "weight", "cells"), 1, n_trees=3, depth=3)
    assert one.depth == 0 and {r.P_hoax for r in f.score(rows, one).collect()} == {1.0}
    bare = rows.selectExpr("post_id", "label", "weight", "map_filter(cells, (k, v) -> false) as cells", "1 as term", "2 as tree", "3 as node")
    flat = f.fit(bare, 5, n_trees=2, depth=3)
    assert flat.depth == 0 and f.score(bare, flat).count() == 12
    twice = f.fit(rows.union(rows), 1, n_trees=2, depth=2)
    assert f.score(rows, twice).count() == 12
