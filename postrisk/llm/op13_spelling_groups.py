"""Operator 13: spelling variants by a relational trie frontier.

The words are a table of trie edges (depth, node, symbol), a node being named by its prefix, with what
the words of the child go on with. A frontier of states (word, position, node, edits) is joined with the edges of one depth
after the other. A state without an edit takes every edge of its node: the edge of its own symbol
leads on, any other is a replaced symbol, and staying at the position is an inserted one; leaving
the word's symbol out needs no edge. A state with its one edit takes the edge of its symbol only.
States that stand at the end of their word on a node where a word ends, with one edit, give
neighbours.

One edit leaves the first or the second half of a word whole. There are two tries, of the words and
of the words reversed, and each carries only edits in the second half: the frontier begins at the
node of the whole half, deep enough that nodes have few edges.

A level is written before the next reads it. The tries hold words of up to ``LEVELS`` code
points, so there are no more levels than that; longer words meet in a join of their
deletion variants (a hash for each place), linear in their length, and are confirmed on the words.

The form of a word is its near word of largest count; forms are followed by pointer doubling, whose
rounds are bounded by the logarithm of the depth, itself bounded by the logarithm of the largest count.

Defined results: a null text has no words; a null id prints as empty text in the damage's hash; a
deleted code point may leave an empty or short result, which is no word; repeated rows count again;
extra columns are ignored; an empty table gives an empty result. Very long runs are read whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import LOWER, write_cut

LEVELS = 24
MIN_LENGTH, MIN_COUNT = 5, 3
PARTIAL_ENTRIES = 300_000
FORWARD, BACKWARD = ">", "<"
_RUN = re.compile("[a-z\u00C0-\u00FF]+")
#: First bytes of UTF-8 characters that are neither ASCII nor U+00C0 to U+00FF.
_OTHER = re.compile(rb"[\xC2\xC4-\xF4]")
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in LOWER.tolist())


def runs(text: str) -> list[bytes]:
    """The letter runs of a text, A-Z lower-cased, in UTF-8."""
    data = text.encode()
    if _OTHER.search(data):
        return [r.encode() for r in _RUN.findall(data.translate(LOWER.tobytes()).decode())]
    return data.translate(_SPACED).split()  # all that isn't ASCII is a letter


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) partial sums; the table of a task is emptied when it has PARTIAL_ENTRIES.

    A run whose hash with its document is divisible by 97 loses one code point."""
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    crc = zlib.crc32
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            head = crc(f"{doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                h = crc(run, head)
                if h % 97 == 0:
                    word = run.decode()
                    k = h % len(word)
                    run = (word[:k] + word[k + 1:]).encode()
                if len(run) > 2 * MIN_LENGTH or len(run) >= MIN_LENGTH and (run.isascii() or len(run.decode()) >= MIN_LENGTH):
                    seen[run] += n
            if len(seen) >= PARTIAL_ENTRIES:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def two_tries(words: DataFrame) -> DataFrame:
    """word, whole: the words, of which the first half stays whole, and reversed, of which the rest does.

    A mark before the first symbol keeps the tries apart; it counts as a symbol of the whole part."""
    half = F.floor(F.length("word") / 2).cast("int")
    return words.select(F.concat(F.lit(FORWARD), "word").alias("word"), (half + 1).alias("whole")).unionByName(
        words.select(F.concat(F.lit(BACKWARD), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("whole")))


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node, symbol, next: one row for each edge of the trie of ``word``. A node is named by its prefix.

    ``next`` lists what the child's words go on with, each after a bar: their next two symbols, one and ``$`` for
    a word that ends after it, ``$`` for one that ends at the child. Words one edit apart have whole parts whose
    lengths differ by one at most, so a word's path is needed from the depth before its own whole part."""
    steps = words.select("word", F.explode(F.sequence(F.greatest(F.col("whole") - 1, F.lit(2)), F.length("word") - 1)).alias("depth"))
    grams = steps.select("depth", F.substring(F.col("word"), F.lit(1), F.col("depth")).alias("node"), _symbol(F.col("depth")).alias("symbol"),
                         F.substring(F.concat("word", F.lit("$")), F.col("depth") + 2, F.lit(2)).alias("gram"))
    grams = grams.groupBy("depth", "node", "symbol", "gram").agg(F.lit(1).alias("one"))
    # a child has at most as many entries as the alphabet has pairs of symbols
    return grams.groupBy("depth", "node", "symbol").agg(
        F.concat(F.lit("|"), F.array_join(F.array_sort(F.collect_list("gram")), "|")).alias("next"))


def _symbol(at) -> F.Column:
    return F.substring(F.col("word"), at + 1, F.lit(1))


def _goes_on(at) -> F.Column:
    """Whether a state with its edit can go on from the node that it has reached: the word's next two symbols, or
    its end, are among what the node's words go on with."""
    return (at <= F.col("len")) & F.contains(F.col("next"), F.concat(F.lit("|"), F.substring(F.concat("word", F.lit("$")), at + 1, F.lit(2))))


def frontier(words: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """(word, near): words and the words that one edit after their whole part leads to.

    A state of the frontier at depth d stands on a node of depth d: (word, at, node, edits), ``at`` symbols read.
    The node of the whole part is known, so a word joins the frontier at that depth. States with their edit that
    can't go on aren't kept. Of equal edits in a run of one symbol only the last is followed."""
    at, c, size = F.col("at"), F.col("symbol"), F.col("len")
    start = write_cut(words.select("word", F.length("word").alias("len"), F.col("whole").alias("at"),
                                   F.substring(F.col("word"), F.lit(1), F.col("whole")).alias("node")).sortWithinPartitions("at"), "op13-start")
    found, state = [], None
    for depth in range(2, levels + 1):
        level = edges.where(F.col("depth") == depth).drop("depth")
        new = start.where(at == depth)
        exact = new if state is None else new.unionByName(state.where("edits = 0").select("word", "len", "at", "node"))
        own, inside = c == _symbol(at), at < size
        changed = ~own | ~inside
        steps = F.inline(F.array(
            F.struct((at + 1).alias("at"), F.lit(0).alias("edits"), (own & inside).alias("ok")),
            # the word's next symbol left out after the step
            F.struct((at + 2).alias("at"), F.lit(1).alias("edits"),
                     (own & inside & (at + 1 < size) & (_symbol(at + 1) != _symbol(at + 2)) & _goes_on(at + 2)).alias("ok")),
            F.struct((at + 1).alias("at"), F.lit(1).alias("edits"), (changed & inside & _goes_on(at + 1)).alias("ok")),  # replaced
            F.struct(at.alias("at"), F.lit(1).alias("edits"), (changed & _goes_on(at)).alias("ok"))))  # inserted
        met = exact.join(level, "node").select("word", "len", F.concat("node", "symbol").alias("node"), steps).where("ok").drop("ok")
        # the first symbol after the whole part left out: the state stays on its node
        left = new.where(inside).select("word", "len", (at + 1).alias("at"), "node")
        edited = left if state is None else left.unionByName(state.where("edits = 1").select("word", "len", "at", "node"))
        moved = (edited.where(inside).withColumn("symbol", _symbol(at)).join(level, ["node", "symbol"]).withColumn("at", at + 1).where(_goes_on(at))
                 .select("word", "len", F.concat("node", "symbol").alias("node"), "at", F.lit(1).alias("edits")))
        after = write_cut(met.unionByName(moved), f"op13-{depth}")
        # on the end of the word a state that was kept stands on a word's node
        found.append(after._scratch)
        state = after.where("edits = 0 or at < len")
    every = words.sparkSession.read.schema(after.schema).parquet(*found)  # one scan for all levels
    return every.where("edits = 1 and at = len").select("word", F.col("node").alias("near"))


def _near(a, b) -> F.Column:
    """Exactly one inserted, deleted or replaced code point."""
    return (F.col(a) != F.col(b)) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, near): every ordered pair of words that are one edit apart. ``words``: distinct words of at least 2 code points."""
    short = two_tries(words.select("word").where(F.length("word") <= levels))
    edges = write_cut(trie_edges(short).sortWithinPartitions("depth"), "op13-edges")
    longest = edges.agg(F.max("depth")).first()[0]
    long = words.select("word").where(F.length("word") >= levels)
    v = long.mapInArrow(_variants, "word string, variant long")
    pairs = (v.join(v.withColumnsRenamed({"word": "near"}), "variant")
             .where((F.length("word") > levels) | (F.length("near") > levels)).select("word", "near").where(_near("word", "near")))
    if longest is not None:
        # the last symbol left out: the state already stands on its terminal node
        last = short.select("word", F.expr("substring(word, 1, length(word) - 1)").alias("near")).join(short.select(F.col("word").alias("near")), "near")
        met = frontier(short, edges, longest + 1).unionByName(last.select("word", "near"))

        def plain(c):
            body = F.expr(f"substring({c}, 2)")
            return F.when(F.startswith("word", F.lit(BACKWARD)), F.reverse(body)).otherwise(body).alias(c)
        pairs = pairs.unionByName(met.select(plain("word"), plain("near")))
    # dealt by ``near`` alone, so that the join with its count needs no further exchange; a word has at most as many
    # neighbours as it has places by symbols
    return pairs.repartition("near").distinct()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a word and of the word without each of its code points: near words share one. Rolling, so linear."""
    p, base = (1 << 61) - 1, 0x2545F4914F6CDD1D

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "variant"])
    rows: list[tuple[str, int]] = []
    for b in batches:
        for word in b.column(0).to_pylist():
            after = [0]  # hash of the symbols from a place on, built from the end
            power = [1]
            for c in reversed(word):
                after.append((ord(c) * power[-1] + after[-1]) % p)
                power.append(power[-1] * base % p)
            after.reverse()
            before, n = 0, len(word)
            seen = {after[0]}
            for k, c in enumerate(word):
                # symbols before k, moved over those after it
                seen.add((before * power[n - k - 1] + after[k + 1]) % p)
                before = (before * base + ord(c)) % p
            for h in sorted(seen):
                rows.append((word, h))
                if len(rows) >= 10_000 or len(rows) * len(word) > 1 << 24:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 2) -> DataFrame:
    """Per word: form, root, n, n_near, form_n; see the module."""
    words = write_cut(word_counts(docs, id_col, text_col), "op13-words")
    pairs = neighbours(words)
    # (word, near) meets the counts once; the word's own side comes from the aggregate's join
    best = (pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b")))
    strong = -F.col("b.m") >= factor * F.col("n")
    out = write_cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("b.near")).alias("form"),
        F.when(strong, -F.col("b.m")).alias("form_n")), "op13-forms")
    top = out.agg(F.max("n")).first()[0] or 1
    depth, jump = max(1, int(top).bit_length()), out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while depth > 1:  # every round doubles the forms that a link covers
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = write_cut(jump.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "op13-roots")
        jump, depth = new, (depth + 1) // 2
    return out.join(jump, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
