"""Operator 11: language-model scores by causal self-attention over subword ids.

Counts: every training text is cut into words; the words of all training texts are counted in
Spark (combined in the tasks first) into one table of (word, count), from which come the totals
of the base score and, by cutting each different word once, the counts of all subword ids.

Model (``attention_lm``): attention predicts the class of the next subword; the id within the class
comes from corpus counts of (class before in the word, id), as does the prior that attention starts
from. Counts, classes and attention weights cover all training texts. The weights are fitted by
stochastic gradients over every window of every training text: texts are dealt by hash into parts of about
``PART_WINDOWS`` windows, the first part gives a common start, then every part goes through all of its
windows from there and the weights are averaged by windows, in fixed point. The deal depends on
ids and texts alone, so neither partitions nor the order of tasks change the model.

Scores: a text is the sequence of its words' subwords and one end. Texts are cut once, into a stored table of ids that
learning and scoring read (another table than the one learnt from is cut the same way). A text's windows overlap; each
subword is scored once, given the inputs before it in its window. A task holds one chunk of
texts, or one text, at a time, and scores it in fixed batches.

The base score needs the count of every word. The ``HEAD`` most frequent words travel in a
broadcast of that size; the others of a text come out as (word, times) rows and are joined with
the count table, then summed per row as decimals, so sums don't depend on the order of tasks.

Defined results: a null text is empty; an empty text is one end token; rows without an id
are neither held out nor learnt from; repeated rows score alike, each on its own row; without
training rows every count is 0 and the model is untrained; extra columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.attention_lm import BATCH, CLASSES, STRIDE, TAIL, WINDOW, AttentionLM, class_table, frequent, windows
from postrisk.llm.common import LOWER, write_cut

HEAD = 1 << 17
PARTIAL_ENTRIES = 300_000
MEMO_ENTRIES = 600_000
CHUNK_WORDS = 60_000
PART_WINDOWS = 600 * BATCH  # a task fits this many windows at a time
FIXED = 1 << 24
# Spark reads lists by batches of rows within a row group, whole in memory: many long texts must not share one
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
_LOWER = LOWER.tobytes()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().translate(_LOWER).split() if text else []


def held_out(id_col: str, folds: int = 10):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


class Cutter:
    """Subword ids of words by a public byte-level vocabulary; a word carries the blank before it."""

    def __init__(self, raw: bytes):
        import public_tokenizers
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.first = np.zeros(self.end + 1, bool)  # ids that begin a word: only there is a blank
        self.first[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def __call__(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode())

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, cut together, and how many each has. No piece of the pattern goes on past the blank of the next word."""
        flat = np.array(self.encode((b" " + b" ".join(words)).decode()) if words else [], np.int64)
        return flat, np.diff(np.append(np.flatnonzero(self.first[flat]), len(flat)))


_cutters: dict[int, Cutter] = {}


def cutter_for(raw: bytes) -> Cutter:
    key = hash(raw)
    if key not in _cutters:
        _cutters.clear()
        _cutters[key] = Cutter(raw)
    return _cutters[key]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) partial sums; the table of a task is emptied when it has PARTIAL_ENTRIES."""
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    for b in batches:
        for text in b.column(0).to_pylist():
            w = words_of(text)
            for i in range(0, len(w), PARTIAL_ENTRIES):
                seen.update(w[i:i + PARTIAL_ENTRIES])
                if len(seen) >= PARTIAL_ENTRIES:
                    yield out()
                    seen.clear()
    if seen:
        yield out()


class Corpus:
    """What is learnt from the training rows: the table of word counts, totals, id tables and the fitted model."""

    def __init__(self, counts: DataFrame, tokens: int, types: int, ends: int, raw: bytes, ids: "IdTable", model: AttentionLM,
                 head: dict[bytes, int], docs: DataFrame, columns: tuple[str, str], cut: DataFrame):
        self.counts, self.tokens, self.types, self.ends = counts, tokens, types, ends
        self.raw, self.ids, self.model, self.head = raw, ids, model, head
        self.docs, self.columns, self.cut = docs, columns, cut  # the table learnt from and its texts as ids


class IdTable:
    """Classes of the ids and P(id | its class, class of the id before it in the word).

    ``keys`` and ``n``: counts of (class before, id), kept as a table of all pairs; a word's first id follows class ``len(mass)``.
    Counts of a pair are smoothed by the ids' counts in their class, ``SMOOTH`` observations strong."""

    SMOOTH = 5.0

    def __init__(self, counts: np.ndarray, classes: np.ndarray, n_classes: int, keys: np.ndarray, n: np.ndarray):
        self.classes, self.size, self.start = classes, len(counts) + 1, n_classes
        mass = np.bincount(classes, weights=counts + 0.1, minlength=n_classes)
        self.within = (counts + 0.1) / mass[classes]
        self.n = np.zeros((n_classes + 1) * self.size, np.int64 if n.max(initial=0) >= 1 << 31 else np.int32)
        self.n[keys] = n
        before, ids = keys // self.size, keys % self.size
        inner = ids < len(counts)  # the id past the last one stands for the end of a word
        self.total = np.zeros((n_classes + 1, n_classes))
        np.add.at(self.total, (before[inner], classes[ids[inner]]), n[inner])
        self.ends = np.bincount(before[~inner], weights=n[~inner], minlength=n_classes)[:n_classes]
        self.mass = mass

    def logs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ln P(id | class, class before) of every id; ``first``: where the words begin."""
        c = self.classes[ids]
        before = np.concatenate([[self.start], c[:-1]])
        before[first] = self.start
        n = self.n[before * self.size + ids]
        return np.log((n + self.SMOOTH * self.within[ids]) / (self.total[before, c] + self.SMOOTH))

    def prior(self, texts: int, end_class: int) -> np.ndarray:
        """ln P(class | class before), over the whole corpus; the last row is the start of a text."""
        uni = self.mass / self.mass.sum()
        words = max(1.0, self.total[-1].sum())
        first = self.total[-1] / words * (1 - min(0.5, texts / words))
        first[end_class] += min(0.5, texts / words)
        p = np.vstack([self.total[:-1] + self.ends[:, None] * first[None], self.total[-1][None] + first[None]])
        p += self.SMOOTH * uni[None]
        return np.log(p / p.sum(1, keepdims=True))


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordCuts:
    """Subword ids and base logs of texts; words are cut once, the new ones of a text together, while a memo of fixed size holds them."""

    def __init__(self, raw: bytes, head: dict[bytes, int], tokens: int, types: int):
        self.cut, self.head = cutter_for(raw), head
        self.floor = tokens + 0.1 * (types + 1)
        self._clear()

    def _clear(self):
        self.places = _Places()
        self.ids, self.at, self.count, self.known = (np.zeros(1 << 10, t) for t in (np.int32, np.int64, np.int64, np.int64))
        self.words = self.size = 0

    def _add(self, words: list[bytes]) -> None:
        flat, n = self.cut.many(words)
        for name, more in (("ids", self.size + len(flat)), *((x, self.words + len(words)) for x in ("at", "count", "known"))):
            old = getattr(self, name)
            if more > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(more, 2 * len(old)) - len(old), old.dtype)]))
        new = slice(self.words, self.words + len(words))
        self.ids[self.size:self.size + len(flat)] = flat
        self.at[new], self.count[new] = self.size + np.cumsum(n) - n, n
        self.known[new] = [self.head.get(w, 0) for w in words]
        self.words, self.size = new.stop, self.size + len(flat)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, float, int, Counter]:
        """(ids with the end, sum of base logs of head words, head words known, other words with their times)."""
        parts, logs, known, other = [], 0.0, 0, Counter()
        for i in range(0, len(words), CHUNK_WORDS):  # a long text bit by bit, so that the memo stays bounded
            part = words[i:i + CHUNK_WORDS]
            if self.words > MEMO_ENTRIES:
                self._clear()
            s = np.fromiter(map(self.places.__getitem__, part), np.int64, len(part))
            if len(self.places) > self.words:
                self._add(list(islice(reversed(self.places), len(self.places) - self.words))[::-1])
            n = self.count[s]
            start = np.repeat(self.at[s] - (np.cumsum(n) - n), n)
            parts.append(self.ids[start + np.arange(len(start))])
            c = self.known[s]
            hit = c > 0
            logs += float(np.log10((c[hit] + 0.1) / self.floor).sum())
            known += int(hit.sum())
            other.update([part[j] for j in np.flatnonzero(~hit)])
        return np.concatenate([*parts, np.array([self.cut.end], np.int32)]), logs, known, other


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    n = np.asarray(lists.value_lengths(), np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])


def fit_attention(seqs: DataFrame, table: np.ndarray, start: AttentionLM, n_windows: int, steps: int) -> AttentionLM:
    """Weights fitted on all windows of (k, ids); every part is one group of about ``PART_WINDOWS`` windows.

    A part makes at least ``steps`` steps, going round if it is small. To the driver comes one line a weight."""
    sc, parts = seqs.sparkSession.sparkContext, max(1, -(-n_windows // PART_WINDOWS))
    dealt = seqs.withColumn("part", F.pmod("k", F.lit(parts)).cast("int"))

    def fitted(rows: DataFrame, model: AttentionLM) -> AttentionLM:
        shared = sc.broadcast((table, model))

        def run(group: pa.Table) -> pa.Table:
            classes, m = shared.value
            flat, bounds = _flat(group.sort_by("k").column("ids").combine_chunks())
            flat, x, t = classes[flat].astype(np.int16), [], []
            for r in _groups(bounds, CHUNK_WORDS):
                lo, hi = bounds[r[0]], bounds[r[-1] + 1]
                a, b, _ = windows(flat[lo:hi], bounds[r[0]:r[-1] + 2] - lo, m.classes)
                x.append(a.astype(np.int16))
                t.append(b.astype(np.int16))
            x, t = np.concatenate(x), np.concatenate(t)
            m = AttentionLM.of(m.classes, m.prior, {k: v.copy() for k, v in m.p.items()})
            m.fit(x, t, steps=max(steps, -(-len(x) // BATCH)))
            v = np.rint(m.vector().astype(np.float64) * FIXED).astype(np.int64)
            return pa.table({"i": np.arange(len(v)), "v": v * len(x), "n": np.full(len(v), len(x))})
        got = (rows.groupBy("part").applyInArrow(run, "i long, v long, n long").groupBy("i")
               .agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v"), F.sum("n").alias("n")).orderBy("i").toArrow())
        shared.unpersist()
        mean = got.column("v").to_numpy() / np.maximum(got.column("n").to_numpy(), 1) / FIXED
        return model.with_vector(mean.astype(np.float32)) if len(mean) else model
    first = fitted(dealt.where("part = 0"), start)
    return first if parts == 1 else fitted(dealt, first)


def learn(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", train_texts: int | None = None,
          steps: int = 600, classes: int = CLASSES) -> Corpus:
    """Counts over all training rows, and the model. ``vocabulary`` is a path that the driver can read.

    ``train_texts``: a bound on the texts that the attention weights are fitted on, for trials; by default all are.
    To the driver come at most a count for each id, for each (class, id) and each neighbour among the frequent ids,
    and the model's weights."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    end = Cutter(raw).end
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(raw)
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = write_cut(train.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "op11-counts")
    ends = train.count()
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, types = int(total[0] or 0) + ends, int(total[1]) + (1 if ends else 0)

    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))

    def summed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, weights=n, minlength=len(k)).astype(np.int64))], ["k", "n"])

    def cut(batches):
        cutter = cutter_for(shared.value)
        for b in batches:
            flat, n = cutter.many(b.column(0).to_pylist())
            yield summed(flat, np.repeat(b.column(1).to_numpy(), n))
    by_id = counts.mapInArrow(cut, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(end + 1)
    n[by_id.column("k").to_numpy()] = by_id.column("n").to_numpy()
    n[end] = ends

    cut_docs = cut_texts(docs, raw, head, tokens, types, id_col, text_col)
    seqs = cut_docs.where(F.col("id").isNotNull() & ~held_out("id")).select("k", "ids")
    own = frequent(n, end, classes - TAIL)
    place = np.full(end + 1, -1, np.int64)
    place[own] = np.arange(len(own))
    shared_place = sc.broadcast(place)

    def beside(batches):
        place, own_n = shared_place.value, int(shared_place.value.max()) + 1
        for b in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            flat, bounds = _flat(b.column(0))
            inside = np.ones(max(0, len(flat) - 1), bool)
            inside[bounds[1:-1] - 1] = False  # a text's end and the next text's start
            x, y = flat[:-1][inside].astype(np.int64), flat[1:][inside].astype(np.int64)
            keys = [a[ok] * (2 * own_n) + place[b_[ok]] + shift for a, b_, shift in ((x, y, 0), (y, x, own_n))
                    for ok in [(place[a] < 0) & (place[b_] >= 0)]]
            keys = np.concatenate(keys)
            yield summed(keys, np.ones(len(keys)))
    near = seqs.select("ids").mapInArrow(beside, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    table = class_table(n, end, near.column("k").to_numpy(), near.column("n").to_numpy(), classes)
    shared_table = sc.broadcast(table)

    def pairs(batches):
        cutter, table = cutter_for(shared.value), shared_table.value
        size = len(table) + 1
        for b in batches:
            flat, size_of = cutter.many(b.column(0).to_pylist())
            flat = np.insert(flat, np.cumsum(size_of), end + 1)
            before = np.concatenate([[classes], table[np.minimum(flat[:-1], end)]]) if len(flat) else flat
            before[1:][flat[:-1] == end + 1] = classes
            yield summed(before * size + flat, np.repeat(b.column(1).to_numpy(), size_of + 1))
    by_pair = counts.mapInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    keys = by_pair.column("k").to_numpy()
    order = np.argsort(keys)
    ids = IdTable(n, table, classes, keys[order], by_pair.column("n").to_numpy()[order].astype(np.float64))

    model = AttentionLM(classes, prior=ids.prior(ends, int(table[end])))
    if ends:
        chosen = seqs if train_texts is None else seqs.orderBy("k").limit(train_texts)
        n_windows = int(chosen.agg(F.sum(F.ceil(F.size("ids") / F.lit(STRIDE)))).first()[0])
        model = fit_attention(chosen, table, model, n_windows, steps)
    return Corpus(counts, tokens, types, ends, raw, ids, model, head, docs, (id_col, text_col), cut_docs)


def cut_texts(docs: DataFrame, raw: bytes, head: dict[bytes, int], tokens: int, types: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's text as subword ids, with what the base score needs: learning and scoring read these, texts are cut once."""
    shared = docs.sparkSession.sparkContext.broadcast((raw, head, tokens, types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = WordCuts(*shared.value)
        for b in batches:
            lo = 0
            while lo < len(b):
                got, n, hi, size = [], [], lo, 0
                while hi < len(b) and (hi == lo or size < CHUNK_WORDS):
                    words = words_of(b.column(2)[hi].as_py())
                    size += len(words)
                    n.append(len(words) + 1)
                    got.append(cuts(words))
                    hi += 1
                bounds = pa.array(np.cumsum([0, *(len(g[0]) for g in got)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([g[0] for g in got]))),
                     pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()),
                     pa.array([list(g[3].items()) for g in got], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))],
                    ["id", "k", "n_tokens", "ids", "logs", "known", "other"])
                lo = hi
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(text_col, F.lit("")), F.lit("lm"))
    return write_cut(docs.select(F.col(id_col).alias("id"), key.alias("k"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, k long, n_tokens long, ids array<int>, logs double, known long, other array<struct<word:binary,times:long>>")
        .withColumn("row", F.monotonically_increasing_id()), "op11-cut", ROW_GROUPS)


class Scorer:
    """Scores texts in a worker, from their words or from their ids."""

    def __init__(self, raw: bytes, head: dict[bytes, int], table: IdTable, model: AttentionLM, tokens: int, types: int):
        self.cuts, self.model, self.table = WordCuts(raw, head, tokens, types), model, table
        self.first = self.cuts.cut.first

    def chunk(self, texts: list[list[bytes]]):
        """Per text: (log10 probability, sum of base logs of head words, head words known, other words with their times)."""
        cut = [self.cuts(words) for words in texts]
        sums = self.sums(np.concatenate([c[0] for c in cut]), np.cumsum([0, *(len(c[0]) for c in cut)]))
        return [(float(p), *c[1:]) for p, c in zip(sums, cut)]

    def sums(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log10 probabilities of texts that follow each other in ``flat``, each closed by its end."""
        lp = self.class_logs(self.table.classes[flat].astype(np.int16), bounds)
        inner = self.table.logs(flat, self.first[flat])
        inner[bounds[1:] - 1] = 0  # the end is alone in its class
        return (np.add.reduceat(lp, bounds[:-1]) + np.add.reduceat(inner, bounds[:-1])) / np.log(10)

    def class_logs(self, classes: np.ndarray, bounds: np.ndarray, windows_at_once: int = 2048) -> np.ndarray:
        out = np.empty(len(classes))
        # blocks of whole texts, or parts of a long text that begin WINDOW inputs early
        part = windows_at_once * STRIDE
        for r in _groups(bounds, part):
            lo, hi = bounds[r[0]], bounds[r[-1] + 1]
            if hi - lo <= part:
                self._score(classes[lo:hi], bounds[r[0]:r[-1] + 2] - lo, out[lo:hi])
                continue
            for a in range(lo, hi, part):  # one long text
                early = min(a - lo, -(-WINDOW // STRIDE) * STRIDE)
                got = np.empty(min(hi, a + part) - a + early)
                self._score(classes[a - early:min(hi, a + part)], np.array([0, len(got)]), got)
                out[a:min(hi, a + part)] = got[early:]
        return out

    def _score(self, classes, bounds, out):
        x, t, place = windows(classes, bounds, self.model.classes)
        lp = self.model.log_probs(x, t)
        ok = place >= 0
        out[place[ok]] = lp[ok]


def _groups(bounds: np.ndarray, part: int) -> Iterator[range]:
    """Consecutive texts of up to ``part`` classes together, or one longer text."""
    r, n = 0, len(bounds) - 1
    while r < n:
        e = max(r + 1, int(np.searchsorted(bounds, bounds[r] + part, "right")) - 1)
        yield range(r, e)
        r = e


def lm_scores(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    learnt = docs is corpus.docs and (id_col, text_col) == corpus.columns
    cut = corpus.cut if learnt else cut_texts(docs, corpus.raw, corpus.head, corpus.tokens, corpus.types, id_col, text_col)
    head = corpus.head
    least = min(head.values(), default=0)
    shared = docs.sparkSession.sparkContext.broadcast((corpus.raw, {}, corpus.ids, corpus.model, corpus.tokens, corpus.types))
    kept = ["row", "id", "n_tokens", "logs", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            size = np.concatenate([[0], np.cumsum(np.asarray(b.column("ids").value_lengths(), np.int64))])
            for r in _groups(size, CHUNK_WORDS):
                part = b.slice(r[0], len(r))
                yield pa.RecordBatch.from_arrays([pa.array(scorer.sums(*_flat(part.column("ids")))), *(part.column(c) for c in kept)], ["score", *kept])
    kind = docs.schema[id_col].dataType.simpleString()
    scored = write_cut(cut.select("ids", *kept).mapInArrow(
        run, f"score double, row long, id {kind}, n_tokens long, logs double, known long"), "op11-scored")

    floor = corpus.tokens + 0.1 * (corpus.types + 1)

    def log(n):
        return F.log10((n + F.lit(0.1)) / F.lit(floor))
    tail = corpus.counts.where(F.col("n") <= least) if head else corpus.counts
    other = cut.select("row", F.explode("other").alias("o")).select("row", "o.word", "o.times")
    n = F.coalesce("n", F.lit(0))
    sums = (other.join(tail, "word", "left").groupBy("row")
            .agg(F.sum((F.col("times") * log(n)).cast("decimal(30,13)")).cast("double").alias("more"),
                 F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known")))
    end = log(F.lit(corpus.ends))
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if corpus.ends else 0)).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"), "score")
