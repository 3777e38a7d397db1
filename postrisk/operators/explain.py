"""Word-level explanations: occlusion attributions, token clean-up, per-word sums, top words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postrisk.constants import TOP_WORDS
from postrisk.functions.text import clean_token, words
from postrisk.session import by_key, materialize

BROADCAST_TERMS = 1_000_000

Scorer = Callable[[DataFrame], DataFrame]  # adds P_hoax from a ``text`` column


def occlusion(df: DataFrame, scorer: Scorer, key: str = "post_id", text_col: str = "text",
              max_tokens: int | None = None) -> DataFrame:
    """Weight of each word = P(text) - P(text without that word), for a whole
    table at once (one scoring pass over all variants; documented as occlusion,
    not Shapley values).

    Every word of the post is explained and scored. A scorer that itself reads only
    the first words (a sequence model) says so with ``max_tokens``. The variants of a
    post grow with the square of its length; for linear scorers use
    ``linear_occlusion``, which needs none."""
    w = words(text_col)
    base = df.select(key, (w if max_tokens is None else F.slice(w, 1, max_tokens)).alias("_w"))
    full = base.select(key, F.lit(-1).alias("_pos"), F.array_join("_w", " ").alias(text_col))
    variants = base.select(key, F.posexplode("_w").alias("_pos", "word"), "_w").select(
        key, "_pos", "word",
        F.array_join(F.filter("_w", lambda w, i: i != F.col("_pos")), " ").alias(text_col))
    scored = scorer(full.unionByName(variants, allowMissingColumns=True))
    p_full = scored.filter(F.col("_pos") == -1).select(key, F.col("P_hoax").alias("_p_full"))
    return (scored.filter(F.col("_pos") >= 0).join(p_full, key)
            .select(key, F.col("_pos").alias("pos"), "word", (F.col("_p_full") - F.col("P_hoax")).alias("weight")))


def fit_naive_bayes(train: DataFrame, text_col: str = "text", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes in table form: (term, log_odds, n: its count) and a 1-row (bias).

    Add-one smoothing for terms and classes. Counts are map-side combined; totals
    are scalar subqueries. The odds are written once, as scorers count and read them."""
    pos = F.col(label) == 1
    docs = train.filter(F.col(label).isin(0, 1))
    n = docs.agg(F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n0"))
    bias = n.select((F.log(F.col("n1") + 1) - F.log(F.col("n0") + 1)).alias("bias"))
    terms = (docs.select(label, F.explode(words(text_col)).alias("term")).groupBy("term")
             .agg(F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n0")))
    t = terms.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count("*").alias("v"))
    t = t.select(F.struct((F.col("t1") + F.col("v")).alias("d1"), (F.col("t0") + F.col("v")).alias("d0"))).scalar()
    odds = (F.log((F.col("n1") + 1) / t["d1"]) - F.log((F.col("n0") + 1) / t["d0"]))
    return materialize(terms.select("term", odds.alias("log_odds"), (F.col("n1") + F.col("n0")).alias("n")), "odds"), bias


def _tokens(df: DataFrame, keys: list[str], text_col: str, outer: bool = False) -> DataFrame:
    split = F.posexplode_outer if outer else F.posexplode
    return df.select(*keys, split(words(text_col)).alias("pos", "word"))


def _with_odds(toks: DataFrame, odds: DataFrame) -> DataFrame:
    """``toks`` with the log odds of their word, 0 for unknown words. A table of odds below a fixed number of terms,
    counted first, is broadcast, so the words stay where they are."""
    o = odds.select(F.col("term").alias("word"), "log_odds")
    o = F.broadcast(o) if odds.count() <= BROADCAST_TERMS else o
    return toks.join(o, "word", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0)))


def _frequent(odds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``odds`` as (word, log_odds) of the most frequent terms, at most ``BROADCAST_TERMS``, and of the others. To the
    driver comes one line for each count that terms have. Without counts all terms are among the others."""
    often, left = F.lit(False), BROADCAST_TERMS
    if "n" in odds.columns:
        for r in odds.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("n")).collect():
            left -= r.terms
            if left < 0:
                break
            often = F.col("n") >= r.n
    o = odds.withColumnRenamed("term", "word")
    return o.where(often).select("word", "log_odds"), o.where(~often).select("word", "log_odds")


def sigmoid(x) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_scores(df: DataFrame, odds: DataFrame, bias: DataFrame, key: str | Sequence[str] = "post_id", text_col: str = "text",
                  out: str = "P_hoax") -> DataFrame:
    """M5 for a table-form linear model: (key, P) of every post; unknown words count nothing.

    ``key`` may be several columns. Words are summed in the tasks first: texts are not shuffled. Where the odds have more terms than
    are broadcast, the frequent ones are, and a second pass shuffles the words that are none of these: they alone meet the other terms."""
    keys = [key] if isinstance(key, str) else list(key)
    b = bias.select("bias").scalar()
    first = F.col("pos").isNull() | (F.col("pos") == 0)  # one for every row of df
    toks = _tokens(df, keys, text_col, outer=True)
    few = odds.count() <= BROADCAST_TERMS
    often, seldom = (None, None) if few else _frequent(odds)
    near = _with_odds(toks, odds) if few else toks.join(F.broadcast(often), "word", "left")
    sums = near.groupBy(*keys).agg(F.sum(F.coalesce("log_odds", F.lit(0.0))).alias("_s"), F.count_if(first).cast("int").alias("_rows"))
    if not few:
        far = (toks.join(F.broadcast(often.select("word")), "word", "left_anti").join(seldom, "word")
               .groupBy(*keys).agg(F.sum("log_odds").alias("_far")))
        sums = sums.join(far, keys, "left").withColumn("_s", F.col("_s") + F.coalesce("_far", F.lit(0.0)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return sums.select(*keys, F.explode(F.array_repeat(sigmoid(F.when(known, F.col("_s")).otherwise(0.0) + b), F.col("_rows"))).alias(out))


def linear_occlusion(df: DataFrame, odds: DataFrame, bias: DataFrame, key: str = "post_id",
                     text_col: str = "text") -> DataFrame:
    """X1 in closed form for a linear scorer: weight = P(text) - P(text without the word), for every
    word of every post, with no variants. With a the log odds of the text and d of the word, the
    difference is s(a) * s(d - a) * (1 - exp(-d)), which keeps its sign where P saturates.

    Texts are dealt by key into tasks of a bounded length, so that neither the sorted words of a task nor
    what a caller groups by key next grow with the table."""
    b = bias.select("bias").scalar()
    toks = _with_odds(_tokens(by_key(df.select(key, text_col), key, text_col), [key], text_col), odds)
    a = F.sum("log_odds").over(Window.partitionBy(key)) + b
    d = F.col("log_odds")
    return toks.withColumn("_a", a).select(
        key, "pos", "word", (sigmoid(F.col("_a")) * sigmoid(d - F.col("_a")) * (1 - F.exp(-d))).alias("weight"))


# ---------------------------------------------------------------- Owen values over a tree of spans

OWEN_LEVELS = 4


def owen_coefficients(levels: int = OWEN_LEVELS) -> dict[int, dict[int, float]]:
    """span -> {coalition: factor}: the Owen value of each of ``2**levels`` spans is the sum of factor * value.

    A binary tree joins neighbouring spans. Going down, a node's credit is split between its halves: each gets
    half its gain with the other half hidden and half its gain with it shown. A coalition is a bit mask of shown spans."""
    width = 1 << levels
    out: dict[int, dict[int, float]] = {j: {} for j in range(width)}
    level = [(0, width, 0, 1.0)]  # first span, spans, shown outside, share
    while level:
        below = []
        for lo, n, shown, share in level:
            if n == 1:
                c = out[lo]
                c[shown | 1 << lo] = c.get(shown | 1 << lo, 0.0) + share
                c[shown] = c.get(shown, 0.0) - share
                continue
            half = n // 2
            first, second = ((1 << half) - 1) << lo, ((1 << half) - 1) << (lo + half)
            below += [(lo, half, shown, share / 2), (lo, half, shown | second, share / 2),
                      (lo + half, half, shown, share / 2), (lo + half, half, shown | first, share / 2)]
        level = below
    return out


def _span_bound(n, j, levels: int):
    """First word of span ``j``: spans are as even as whole words allow, the tree is balanced."""
    return F.floor(n * j / F.lit(float(1 << levels))).cast("int")


def _span_credits(values: DataFrame, key: str, levels: int) -> DataFrame:
    """(key, credits: one for each span) from (key, coalition, P): the factors are a table of fixed size."""
    table = [(j, m, c) for j, by in owen_coefficients(levels).items() for m, c in by.items() if c]
    factors = values.sparkSession.createDataFrame(table, "span int, coalition int, factor double")
    part = F.col("factor") * F.col("P_hoax")
    return (values.join(F.broadcast(factors), "coalition").groupBy(key)
            .agg(F.array(*[F.sum(F.when(F.col("span") == j, part)) for j in range(1 << levels)]).alias("credits")))


def _span_of(pos, n, levels: int):
    """The span of a word: the last that begins at or before it."""
    return F.ceil((pos + 1) * F.lit(float(1 << levels)) / n).cast("int") - 1


def _word_credits(df: DataFrame, credits: DataFrame, key: str, text_col: str, levels: int) -> DataFrame:
    """(key, pos, word, weight): a span's credit is shared evenly by its words."""
    # the length is taken before the words are dealt out: beside them it would be counted again for every word
    toks = (df.select(key, words(text_col).alias("_w"), F.size(words(text_col)).alias("_n")).join(credits, key)
            .select(key, "credits", "_n", F.posexplode("_w").alias("pos", "word"))
            .withColumn("_j", _span_of(F.col("pos"), F.col("_n"), levels)))
    size = _span_bound(F.col("_n"), F.col("_j") + 1, levels) - _span_bound(F.col("_n"), F.col("_j"), levels)
    return toks.select(key, "pos", "word", (F.get("credits", F.col("_j")) / size).alias("weight"))


def owen(df: DataFrame, scorer: Scorer, key: str = "post_id", text_col: str = "text", levels: int = OWEN_LEVELS) -> DataFrame:
    """Owen values (Shapley values over a tree of word spans) of every word for any scorer.

    A text is cut into ``2**levels`` spans (texts of fewer words: one word each), and every coalition of the tree
    is a masked text; all of all posts are scored as one table. Their number depends on ``levels`` only, so the
    scored text grows with the length of a post and not with its square. The weights of a post add
    up to P(text) - P(empty text). Scores are joined with a table of factors, so nothing is collected."""
    df = by_key(df.select(key, text_col), key, text_col)  # a post's coalitions and words stay in its task
    masks = sorted({m for by in owen_coefficients(levels).values() for m in by})
    n = F.size("_w")
    spans = F.transform(F.sequence(F.lit(0), F.lit((1 << levels) - 1)), lambda j: F.slice(
        F.col("_w"), _span_bound(n, j, levels) + 1, _span_bound(n, j + 1, levels) - _span_bound(n, j, levels)))
    masked = (df.select(key, words(text_col).alias("_w")).select(key, spans.alias("_s"))
              .select(key, "_s", F.explode(F.array(*[F.lit(m) for m in masks])).alias("coalition"))
              .select(key, "coalition", F.array_join(F.flatten(F.filter("_s", lambda _, j: _shown(F.col("coalition"), j))), " ").alias(text_col)))
    credits = _span_credits(scorer(masked).select(key, "coalition", "P_hoax"), key, levels)
    return _word_credits(df, credits, key, text_col, levels)


def _shown(coalition, j):
    return F.getbit(coalition, j) == 1


def _linear_credits(s: list, b, levels: int):
    """The spans' Owen values as an array, from their sums of log odds ``s`` and the bias ``b``.

    Going down the tree, a node carries the log odds of everything that may be shown outside it;
    a span's value is the mean gain over what its leaf carries."""
    def gain(mine):
        return lambda acc, c: acc + (sigmoid(c + mine) - sigmoid(c))

    def also(outside, shown):
        return F.concat(outside, F.transform(outside, lambda c: c + shown))

    nodes = [(0, 1 << levels, F.array(b))]
    for _ in range(levels):
        below = []
        for lo, n, outside in nodes:
            half = n // 2
            first, second = sum(s[lo + 1:lo + half], s[lo]), sum(s[lo + half + 1:lo + n], s[lo + half])
            below += [(lo, half, also(outside, second)), (lo + half, half, also(outside, first))]
        nodes = below
    return F.array(*[F.aggregate(outside, F.lit(0.0), gain(s[lo])) / (1 << levels) for lo, _, outside in nodes])


def linear_owen(df: DataFrame, odds: DataFrame, bias: DataFrame, key: str = "post_id", text_col: str = "text",
                levels: int = OWEN_LEVELS) -> DataFrame:
    """Owen values for a linear scorer: a coalition's score follows from the spans' sums of log odds, so
    no masked text and no coalition becomes a row: a post is one row of sums, its credits one array."""
    b = bias.select("bias").scalar()
    size = 1 << levels
    df = by_key(df.select(key, text_col), key, text_col)
    counted = df.select(key, words(text_col).alias("_w"), F.size(words(text_col)).alias("_n"))
    toks = _with_odds(counted.select(key, "_n", F.posexplode("_w").alias("pos", "word")), odds)
    span = _span_of(F.col("pos"), F.col("_n"), levels)
    sums = toks.select(key, span.alias("span"), "log_odds").groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col("span") == j, F.col("log_odds"))), F.lit(0.0)).alias(f"_s{j}") for j in range(size)],
        (F.min(F.lit(0.0)) + b).alias("_b"))  # a column of the aggregate: lambdas take no subquery
    credits = sums.select(key, _linear_credits([F.col(f"_s{j}") for j in range(size)], F.col("_b"), levels).alias("credits"))
    return _word_credits(df, credits, key, text_col, levels)


def positive_class(c) -> F.Column:
    """The class-1 value when attributions are given per class (array), else the value."""
    col = F.col(c) if isinstance(c, str) else c
    return col[1]


def clean_tokens(df: DataFrame, token_col: str = "word") -> DataFrame:
    """Drop special tokens and punctuation-only tokens, remove ``##``, lower-case
    (pieces are not re-joined)."""
    return df.withColumn(token_col, clean_token(token_col)).filter(F.col(token_col).isNotNull())


def word_weights(df: DataFrame, key: str = "post_id", word: str = "word", weight: str = "weight") -> DataFrame:
    """Sum of weights per (post, word), keeping positive sums."""
    return (df.groupBy(key, word).agg(F.sum(weight).alias(weight))
            .filter(F.col(weight) > 0))


def top_words(df: DataFrame, k: int = TOP_WORDS, key: str = "post_id", word: str = "word",
              weight: str = "weight", tie_digits: int = 9) -> DataFrame:
    """The ``k`` heaviest words per post (ties by word; weights equal to
    ``tie_digits`` decimals are ties, so summation order cannot reorder them).
    A constant ``k`` is planned as a group limit applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.round(weight, tie_digits).desc(), F.asc(word))
    return (word_weights(df, key, word, weight).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))
