"""Subword encoding by longest match, with ``##`` for pieces inside a word.

A vocabulary is a table (piece, id): every piece that begins a word, and ``##`` with every piece that
goes on. It is given (a published word-piece list, one piece a row) or counted from a corpus
(``count_pieces``); nothing is merged or trained.

Every different word is cut once, whatever its number of occurrences: its substrings meet the vocabulary in
one join, the longest match of each start remains, and one fold walks the word from match to match. The
words of the posts then meet their pieces: up to ``HEAD_WORDS`` of the most frequent words are broadcast, only the others
are joined by word, so neither the bulk of the words nor a frequent one is shuffled. A word over ``MAX_WORD`` characters, or with a place where no
piece fits, is one unknown piece, as is usual for this format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postrisk.constants import MAX_SEQ_LEN
from postrisk.functions.text import words
from postrisk.session import materialize

PAD, UNK, BEGIN, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIAL = (PAD, UNK, BEGIN, END)  # ids 0 to 3
VOCAB_SIZE = 8000
MAX_PIECE, MAX_WORD = 8, 100
BROADCAST_MAX_PIECES = 200_000
HEAD_WORDS = 50_000


def _pieces_at(word: str = "word", max_piece: int = MAX_PIECE) -> F.Column:
    """Array of (start, piece): all substrings of up to ``max_piece`` characters; inside a word with ``##``."""
    starts = F.sequence(F.lit(0), F.length(word) - 1)
    return F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_piece), F.length(word) - s)),
        lambda n: F.struct(s.alias("start"), n.alias("n"),
                           F.concat(F.when(s > 0, F.lit("##")).otherwise(F.lit("")), F.substring(F.col(word), s + 1, n)).alias("piece")))))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n), combined before the shuffle."""
    return df.select(F.explode(words(text_col)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def count_pieces(df: DataFrame, text_col: str = "text", size: int = VOCAB_SIZE, max_piece: int = MAX_PIECE) -> DataFrame:
    """(piece, id): every single character seen, then the most frequent pieces (by occurrences times
    characters, ties by piece), ``size`` in all with the special ones, which come first.

    All words of the corpus count; only the result is cut to ``size``."""
    counts = word_counts(df, text_col).where(F.length("word") <= MAX_WORD)
    pieces = (counts.select("n", F.explode(_pieces_at(max_piece=max_piece)).alias("p"))
              .groupBy("p.piece", F.col("p.n").alias("len")).agg(F.sum("n").alias("n")))
    first = Window.partitionBy(F.lit(1)).orderBy(F.col("len") > 1, F.desc(F.col("n") * F.col("len")), "piece")
    top = pieces.orderBy(F.col("len") > 1, F.desc(F.col("n") * F.col("len")), "piece").limit(int(size) - len(SPECIAL))
    return top.select("piece", (F.row_number().over(first) - 1 + len(SPECIAL)).cast("int").alias("id"))


def _vocab_side(vocab: DataFrame, vocab_size: int) -> DataFrame:
    return F.broadcast(vocab) if vocab_size <= BROADCAST_MAX_PIECES else vocab


def cut_words(vocab: DataFrame, some_words: DataFrame, max_piece: int = MAX_PIECE, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """(word, pieces array of (piece, id)) of a table of distinct words: longest match first, from the left."""
    v = _vocab_side(vocab.select("piece", "id"), vocab_size)
    short = some_words.select("word").where(F.length("word").between(1, MAX_WORD))
    fit = (short.select("word", F.explode(_pieces_at(max_piece=max_piece)).alias("p")).select("word", "p.start", "p.n", "p.piece").join(v, "piece")
           .groupBy("word", "start").agg(F.max(F.struct("n", "piece", "id")).alias("m")))
    # at most MAX_WORD entries a word
    by_word = fit.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "m"))).alias("fits"))
    piece = "array<struct<piece:string,id:int>>"
    walk = F.aggregate("fits", F.struct(F.lit(0).alias("at"), F.array().cast(piece).alias("out")),
                       lambda acc, f: F.when(f["start"] == acc["at"], F.struct(
                           (acc["at"] + f["m"]["n"]).alias("at"),
                           F.concat(acc["out"], F.array(F.struct(f["m"]["piece"].alias("piece"), f["m"]["id"].alias("id")))).alias("out"))).otherwise(acc))
    unknown = F.array(F.struct(F.lit(UNK).alias("piece"), F.lit(SPECIAL.index(UNK)).alias("id")))
    walked = by_word.select("word", walk.alias("w"))
    return some_words.select("word").join(walked, "word", "left").select(
        "word", F.when(F.col("w.at") == F.length("word"), F.col("w.out")).otherwise(unknown).alias("pieces"))


def with_pieces(toks: DataFrame, vocab: DataFrame, max_piece: int = MAX_PIECE, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """The rows of ``toks`` with the pieces of their word. ``toks`` is read for its counts, for the frequent words, and,
    if there are more than ``HEAD_WORDS``, once again for the others."""
    counts = materialize(toks.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "word-counts")
    cut = materialize(cut_words(vocab, counts, max_piece, vocab_size).join(counts, "word"), "word-pieces")
    beyond = cut.select("_n").orderBy(F.desc("_n")).limit(HEAD_WORDS + 1).agg(F.min("_n"), F.count(F.lit(1))).first()
    least = beyond[0] if beyond[1] > HEAD_WORDS else 0
    head = F.broadcast(cut.where(F.col("_n") > least).drop("_n"))
    met = toks.join(head, "word")
    if not least:
        return met
    tail = cut.where(F.col("_n") <= least).drop("_n")
    return met.unionByName(toks.join(head.drop("pieces"), "word", "left_anti").join(tail, "word"))


def subword_pieces(df: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "post_id", max_piece: int = MAX_PIECE,
                   vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """(key, pos, part, piece, id): every piece of every word of the whole texts, by word and place in it."""
    toks = df.select(key, F.posexplode(words(text_col)).alias("pos", "word")).where("word <> ''")
    return with_pieces(toks, vocab, max_piece, vocab_size).select(key, "pos", F.posexplode("pieces").alias("part", "p")).select(key, "pos", "part", "p.piece", "p.id")


def encode_subwords(df: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "post_id", max_len: int = MAX_SEQ_LEN,
                    max_piece: int = MAX_PIECE, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """key, n_pieces (of the whole text), input_ids and attention_mask: begin mark, the first ``max_len - 2``
    pieces, end mark, padding. A post without words has the two marks alone."""
    room = max_len - 2
    toks = df.select(key, F.posexplode(words(text_col)).alias("pos", "word")).where("word <> ''")
    # a word has a piece at least, so only the first words can reach into the sequence
    per = with_pieces(toks, vocab, max_piece, vocab_size).groupBy(key).agg(
        F.sum(F.size("pieces")).alias("n_pieces"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < room, F.struct("pos", F.transform("pieces", lambda p: p["id"]).alias("ids"))))).alias("_p"))
    ids = F.slice(F.flatten(F.transform(F.coalesce("_p", F.array().cast("array<struct<pos:int,ids:array<int>>>")), lambda s: s["ids"])), 1, room)
    seq = F.concat(F.array(F.lit(SPECIAL.index(BEGIN))), ids, F.array(F.lit(SPECIAL.index(END))))
    out = df.select(key).join(per, key, "left").select(key, F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"), seq.alias("_seq"))
    pad = F.lit(max_len) - F.size("_seq")
    return out.select(key, "n_pieces", F.concat("_seq", F.array_repeat(F.lit(0), pad)).alias("input_ids"),
                      F.concat(F.transform("_seq", lambda _: F.lit(1)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))
