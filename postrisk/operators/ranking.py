"""Exact ranks inside groups without sending a whole group to one task.

A plain ``row_number()`` over ``partitionBy(label)`` puts each group in one
task: with two labels the job has two busy tasks, and a group holding a third
of all rows must fit one executor. Here rows are first cut into ``B`` ranges
of the order key per group (equal-count ranges from quantiles, or equal-width
ranges for a key that is uniform on [0, 1)); the row count of every
(group, range) - a small table - is prefix-summed, and the final
``row_number`` only runs inside one range, so ``B`` tasks share each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 16  # ranges of a group at least
QUANTILE_BUCKETS = None  # equal-count ranges, sized by a count of the table
BROADCAST_MAX_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A table of groups or ranges: broadcast after counting that it is small, so that the rows it
    meets aren't exchanged on the bare group; a longer one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


ROWS_PER_BUCKET = 1_000_000


def with_count_below(df: DataFrame, bounds: str, key, n_bounds: int, out: str) -> DataFrame:
    """``out`` = number of entries of the ascending array ``bounds`` strictly below
    ``key``, by binary search: one fold over the ~log2(n_bounds) step sizes
    instead of a scan of the whole array for every row."""
    k = F.col(key).cast("double") if isinstance(key, str) else key.cast("double")
    steps = []
    step = 1
    while step * 2 <= n_bounds:
        step *= 2
    while step >= 1:
        steps.append(step)
        step //= 2
    b = F.col(bounds)

    def advance(pos, st):
        nxt = pos + st
        probe = F.when(nxt <= F.size(b), F.element_at(b, nxt))
        return F.when(probe < k, nxt).otherwise(pos)

    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), advance)
    return df.withColumn(out, found)


def with_group_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    out: str = "_rank", buckets: int | None = DEFAULT_BUCKETS,
                    uniform: bool = False, accuracy: int = 10000, limit=None,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``out`` = 1-based rank of each row inside its group, ordered by
    ``order_cols`` (the first must be numeric; later ones break ties).

    ``uniform=True`` when the first order column is uniform on [0, 1) (e.g. a
    hash): ranges are equal-width and their number follows each group's size
    (about ``rows_per_bucket`` rows per range, at least ``buckets``), so a
    huge group is still cut into task-sized pieces. Otherwise ``buckets``
    equal-count ranges come from ``percentile_approx`` (``None``: by ``auto_buckets``).

    ``limit`` (a column or a number) keeps only rows that can rank within it:
    ranges starting after the cut are dropped before the window runs."""
    group_cols = list(group_cols)
    key = order_cols[0]
    if buckets is None:
        buckets = DEFAULT_BUCKETS if uniform else auto_buckets(df)
        accuracy = max(int(accuracy), 10 * int(buckets))
    if uniform:
        sizes = df.groupBy(*group_cols).agg(
            F.greatest(F.lit(int(buckets)), F.ceil(F.count(F.lit(1)) / F.lit(float(rows_per_bucket))))
            .cast("int").alias("_nb"))
        b = df.join(small_side(sizes), group_cols, "left").withColumn(
            "_bucket", F.least(F.floor(F.col(key) * F.col("_nb")).cast("int"), F.col("_nb") - 1)).drop("_nb")
    else:
        probs = [i / buckets for i in range(1, buckets)]
        bounds = df.groupBy(*group_cols).agg(
            F.percentile_approx(F.col(key).cast("double"), probs, accuracy).alias("_bounds"))
        # bucket = number of boundaries strictly below the key: equal keys share a bucket
        b = with_count_below(df.join(small_side(bounds, BROADCAST_MAX_ROWS // buckets + 1), group_cols, "left"), "_bounds", key, buckets - 1,
                             "_bucket").drop("_bounds")
    counts = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # small table (groups x buckets): exclusive prefix sum per group
    wp = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(wp), F.lit(0))).drop("_n")
    ranked = b.join(small_side(offsets), [*group_cols, "_bucket"], "left")
    if limit is not None:
        lim = F.col(limit) if isinstance(limit, str) else F.lit(limit)
        ranked = ranked.filter(F.col("_offset") < lim)
    wr = Window.partitionBy(*group_cols, "_bucket").orderBy(*[F.col(c) for c in order_cols])
    return (ranked.withColumn(out, F.col("_offset") + F.row_number().over(wr))
            .drop("_offset", "_bucket"))


CUT_BINS = 4096


def rank_histogram(narrow: DataFrame, group: str, u: str = "_u", bins: int = CUT_BINS) -> DataFrame:
    """(group, _bin, _lo, _hi): how many rows of a group lie before and up to the end of each bin of a number in [0, 1)."""
    h = narrow.groupBy(group, F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    hi = F.sum("_n").over(Window.partitionBy(group).orderBy("_bin"))
    return h.select(group, "_bin", (hi - F.col("_n")).alias("_lo"), hi.alias("_hi"))


def rank_cuts(narrow: DataFrame, group: str, histogram: DataFrame, ranks: DataFrame, names: Sequence[str], u: str = "_u",
              key: str = "_key", bins: int = CUT_BINS) -> DataFrame:
    """(group, <name> struct(u, key)): the order key at each rank of ``ranks`` (group and one column a name; null at rank 0).

    The histogram tells the one bin that holds a rank; only the rows of that bin, about one in ``bins``, are
    ordered, and of those only their order keys. A row's rank is within a cut just if its key is not above it,
    so rows can be told apart by one comparison, without ranking or exchanging them."""
    todo = None
    for name in names:
        hit = (histogram.join(ranks.select(group, F.col(name).alias("_rank")), group).where((F.col("_lo") < F.col("_rank")) & (F.col("_rank") <= F.col("_hi")))
               .select(group, "_bin", F.lit(name).alias("_name"), (F.col("_rank") - F.col("_lo")).alias("_nth")))
        todo = hit if todo is None else todo.unionByName(hit)
    rows = narrow.withColumn("_bin", F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)))
    nth = F.row_number().over(Window.partitionBy(group, "_name").orderBy(u, key))
    at = rows.join(todo, [group, "_bin"]).withColumn("_at", nth).where(F.col("_at") == F.col("_nth"))
    return at.groupBy(group).agg(*[F.max(F.when(F.col("_name") == n, F.struct(F.col(u), F.col(key)))).alias(n) for n in names])


GROUP_LIMIT = 100_000


def first_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n_col, most: int) -> DataFrame:
    """``top_n_per_group`` where no group keeps more than ``most`` rows: a constant bound is planned as a group
    limit before the exchange, so every task sends at most that many rows of a group."""
    if most > GROUP_LIMIT:  # too many for one task a group: ranges
        return top_n_per_group(df, group_cols, order_cols, n_col)
    w = Window.partitionBy(*group_cols).orderBy(*[F.col(c) for c in order_cols])
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= int(most))
    return ranked.where(F.col("_rank") <= F.col(n_col)).drop("_rank")


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n_col,
                    buckets: int | None = QUANTILE_BUCKETS, uniform: bool = False) -> DataFrame:
    """Rows whose rank inside their group is ``<= n_col`` (a column or a number).
    Only the ranges up to the cut are ranked."""
    n = F.col(n_col) if isinstance(n_col, str) else F.lit(n_col)
    ranked = with_group_rank(df, group_cols, order_cols, buckets=buckets, uniform=uniform, limit=n_col)
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


MAX_QUANTILE_BUCKETS = 100_000


def auto_buckets(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Number of equal-count ranges so that one range holds about ``rows_per_bucket``
    rows (one count of the table; at least ``DEFAULT_BUCKETS``)."""
    n = df.count()
    return int(min(MAX_QUANTILE_BUCKETS, max(DEFAULT_BUCKETS, -(-n // rows_per_bucket))))


def with_running_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, value_cols: Sequence[str],
                      descending: bool = True, buckets: int | None = QUANTILE_BUCKETS,
                      accuracy: int = 10000) -> DataFrame:
    """Adds ``cum_<v>`` = running sum of each value column inside the group, in
    ``order_col`` order, inclusive (rows should have distinct ``order_col``
    per group, e.g. after grouping by it).

    Same bucketing as ``with_group_rank``: per-range totals are prefix-summed on
    the small (group x range) table, the running sum only spans one range.
    ``buckets=None`` sizes the ranges from the table (see ``auto_buckets``)."""
    group_cols = list(group_cols)
    if buckets is None:
        buckets = auto_buckets(df)
    accuracy = max(int(accuracy), 10 * int(buckets))
    key = F.col(order_col).cast("double")
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*group_cols).agg(F.percentile_approx(key, probs, accuracy).alias("_bounds")) \
        if group_cols else df.agg(F.percentile_approx(key, probs, accuracy).alias("_bounds"))
    if group_cols:
        b = df.join(small_side(bounds, BROADCAST_MAX_ROWS // buckets + 1), group_cols, "left")
    else:
        b = df.withColumn("_bounds", bounds.select("_bounds").scalar())
    b = with_count_below(b, "_bounds", key, buckets - 1, "_nb")
    nb = F.col("_nb")
    b = b.withColumn("_bucket", (F.lit(buckets) - nb) if descending else nb).drop("_bounds", "_nb")
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    part = group_cols if group_cols else [F.lit(1)]
    wp = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_bucket",
                            *[F.coalesce(F.sum(f"_t_{v}").over(wp), F.lit(0)).alias(f"_o_{v}")
                              for v in value_cols])
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    wr = Window.partitionBy(*group_cols, "_bucket").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(small_side(offsets), [*group_cols, "_bucket"], "left")
    out = out.withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.sum(v).over(wr) for v in value_cols})
    return out.drop("_bucket", *[f"_o_{v}" for v in value_cols])
