"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line of a document gets features of its own and of the lines next to it
(shares of letters, capitals, digits, symbols and separators, repeated words,
repeated lines, word lengths, how it begins and ends). A chain with two states,
bad and good, scores the sequence; forward-backward gives each line's probability
of being good, and the length-weighted mean over the lines is the document's
quality, put on a probability scale by a one-variable logistic fit.

Training uses labelled documents only, never held-out ones, and no column but the
text: a sample of at most ``train_docs`` documents by hash order, of each at most
``train_lines`` lines in a row from a hashed place. Lines start with their
document's label; after a first fit, lines of bad documents that the chain
thinks good are relabelled and the fit goes on. The features of the sample are
made in Spark; the fit itself is a few seconds of numpy whose size the two bounds
fix. Scoring reads every text whole.

Defined results: null and empty texts are one empty line and get its score; rows
with contradicting labels don't train; with no labels, or only one class, every
document gets the smoothed share of label 1; repeated rows score alike; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import IS_BLANK, Words, byte_table, chunks, covered, grams, hash_sample, prefix_hash, \
    seen_before, span_hash, within_rows
from postrisk.llm.op9_quality_rules import IS_LETTER, IS_SYMBOL, IS_UPPER, line_spans

IS_DIGIT = byte_table("0123456789")
IS_BAR = byte_table("|")
IS_BANG = byte_table("!?")
IS_STOP = byte_table(".,;:")
IS_END = byte_table(".!?:;\"')")
OWN = 18  # features of a line itself
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines by FEATURES, weight of each line, row of each line) of a chunk."""
    start, end, row = line_spans(data, offs)
    w = Words(data, offs, IS_BLANK)
    prefix = prefix_hash(data)
    h = span_hash(prefix, w.starts, w.ends)
    a, b = np.searchsorted(w.starts, start), np.searchsorted(w.starts, end)
    n_bytes, n_words = end - start, b - a

    def count(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return c[hi] - c[lo]
    g, inside = grams(h, w.row, 3)
    at = np.flatnonzero(inside)
    _, twice = seen_before(within_rows(g[at], w.row[at]))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    _, same_line = seen_before(within_rows(span_hash(prefix, start, end), row))
    letters = count(IS_LETTER[data], start, end)
    in_words = np.maximum(count(w.mask, start, end), 1)
    words, letters_1 = np.maximum(n_words, 1), np.maximum(letters, 1)
    first = np.where(n_words > 0, data[w.starts[np.minimum(a, max(0, len(w) - 1))]] if len(w) else 0, 32)
    last = np.where(n_words > 0, data[w.ends[np.maximum(b - 1, 0)] - 1] if len(w) else 0, 32)
    n_rows = len(offs) - 1
    lines_of = np.bincount(row, minlength=n_rows)[row]
    own = np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), in_words / words / 10, n_words == 0, letters / in_words,
        count(IS_UPPER[data], start, end) / letters_1, count(IS_DIGIT[data], start, end) / in_words,
        count(IS_SYMBOL[data], start, end) / in_words, count(IS_BAR[data], start, end) / words,
        count(IS_BANG[data], start, end) / words, count(IS_STOP[data], start, end) / words,
        count(again, a, b) / words, count(covered(at[twice], 3, len(w)), a, b) / words, same_line,
        IS_UPPER[first] | (first >= 128), IS_END[last], np.minimum(lines_of, 50) / 50,
        (count(again, a, b) / words > 0.3)]).astype(np.float32)
    out = np.zeros((len(row), FEATURES), np.float32)
    out[:, :OWN] = own
    together = row[1:] == row[:-1]
    out[1:, OWN:2 * OWN][together] = own[:-1][together]
    out[:-1, 2 * OWN:3 * OWN][together] = own[1:][together]
    out[:, -1] = 1
    return out, np.maximum(n_bytes, 1).astype(np.float64), row


class Chain:
    """Two-state chain over many sequences at once; sequence s is lines ``at[s]:at[s + 1]``."""

    def __init__(self, at: np.ndarray):
        n = np.diff(at)
        order = np.argsort(-n, kind="stable")
        self.first, self.n = at[:-1][order], n[order]
        # how many sequences have a t-th line, longest sequences first
        self.alive = len(n) - np.searchsorted(self.n[::-1], np.arange(self.n[0] if len(n) else 0), "right")

    def marginals(self, unary: np.ndarray, trans: np.ndarray, edges: bool = False):
        """Probability that each line is good; with ``edges`` also the expected transitions, summed."""
        n = len(unary)
        u = np.column_stack([np.zeros(n), unary])
        fwd, bwd = u.copy(), np.zeros((n, 2))
        for t in range(1, len(self.alive)):
            i = self.first[:self.alive[t]] + t
            p = fwd[i - 1]
            fwd[i] += np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
        for t in range(len(self.alive) - 1, 0, -1):
            i = self.first[:self.alive[t]] + t
            x = u[i] + bwd[i]
            bwd[i - 1] = np.logaddexp(x[:, :1] + trans[:, 0], x[:, 1:] + trans[:, 1])
        both = fwd + bwd
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        if not edges:
            return good
        inner = np.ones(n, bool)
        inner[self.first[self.n > 0]] = False
        i = np.flatnonzero(inner)
        z = np.logaddexp(both[i, 0], both[i, 1])
        e = fwd[i - 1][:, :, None] + trans + (u[i] + bwd[i])[:, None, :] - z[:, None, None]
        return good, np.exp(e), i


@dataclass
class Model:
    weights: np.ndarray | None
    trans: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    slope: float
    bias: float

    def lines(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return Chain(at).marginals(((x - self.mean) / self.scale) @ self.weights, self.trans)

    def score(self, x: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(at) - 1, self.bias)
        return self.calibrated(mean_by(self.lines(x, at), size, at))

    def calibrated(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(m) + self.bias, -60, 60)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def mean_by(good: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length-weighted mean per document; every document has a line."""
    return np.add.reduceat(good * size, at[:-1]) / np.add.reduceat(size, at[:-1])


class _Adam:
    def __init__(self, *params: np.ndarray, rate: float = 0.05):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)


def fit(x: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray, steps: int = 100, l2: float = 1e-3) -> Model:
    """x: lines by features; document d is lines at[d]:at[d + 1] and has label[d] in {0, 1}."""
    if len(label) == 0 or label.min() == label.max():
        return Model(None, None, None, None, 0.0, float((label.sum() + 1) / (len(label) + 2)))
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1).astype(np.float32)
    mean[-1] = 0  # the constant
    z = ((x - mean) / scale).astype(np.float64)
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    y = label[doc].astype(np.float64)
    share = label.mean()
    # lines weigh by document and class, so that long documents don't drown the others
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))[doc] / np.diff(at)[doc]
    weight /= weight.sum()
    chain = Chain(at)
    w, trans = np.zeros(FEATURES), np.array([[1.0, -1.0], [-1.0, 1.0]])
    for again in range(3):
        opt = _Adam(w, trans)
        for _ in range(steps):
            good, edge, i = chain.marginals(z @ w, trans, edges=True)
            seen = np.zeros_like(edge)
            seen[np.arange(len(i)), y[i - 1].astype(int), y[i].astype(int)] = 1
            opt.step(z.T @ (weight * (good - y)) + l2 * w, ((edge - seen) * weight[i][:, None, None]).sum(0) + l2 * trans)
        if again < 2:
            good = chain.marginals(z @ w, trans)
            y = label[doc].astype(np.float64)
            doubtful = (label[doc] == 0) & (good > 0.8)
            worst = np.minimum.reduceat(good, at[:-1])[doc]
            y[doubtful & (good > worst)] = 1  # a bad document keeps a bad line
    m = _logit(mean_by(chain.marginals(z @ w, trans), size, at))
    ab = np.array([1.0, 0.0])
    opt = _Adam(ab)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * m + ab[1], -60, 60)))
        opt.step(np.array([((p - label) * m).mean(), (p - label).mean()]) + 1e-3 * np.array([ab[0] - 1, ab[1]]))
    return Model(w, trans, mean, scale, float(max(ab[0], 1e-3)), float(ab[1]))


def held_out(id_col: str | Column = "doc_id") -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def _sample_features(train_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                x, size, row = line_features(data, offs)
                at = np.searchsorted(row, np.arange(j - i + 1))
                out: list[list] = [[], []]
                for k, place in enumerate(b.column(0).slice(i, j - i).to_pylist()):
                    n = at[k + 1] - at[k]
                    lo = at[k] + (place % (n - train_lines + 1) if n > train_lines else 0)
                    hi = min(at[k + 1], lo + train_lines)
                    out[0].append(x[lo:hi].tobytes())
                    out[1].append(size[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i),
                     pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["place", "label", "x", "size"])
    return run


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, train_lines: int = 64, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the labelled documents that are not held out: at most ``train_docs`` by ``train_lines`` lines."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("long").alias("label"), F.max(label_col).alias("top"))
             .where("label = top"))
    place = F.pmod(F.xxhash64("__id", F.lit("train")), F.lit(1 << 40))
    chosen = hash_sample(known.select("__id", "label", place.alias("place")), train_docs, "__id")
    texts = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text"))  # other columns may have any name
    rows = (texts.join(F.broadcast(chosen), F.col("of") == F.col("__id")).select("place", "text", "label")
            .mapInArrow(_sample_features(train_lines), "place long, label long, x binary, size binary")
            .orderBy("place", "label", F.xxhash64("x")).limit(train_docs).collect())
    x = np.concatenate([np.zeros((0, FEATURES), np.float32), *[np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]])
    size = np.concatenate([np.zeros(0), *[np.frombuffer(r["size"]) for r in rows]])
    at = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in rows])]).astype(np.int64)
    return fit(x, size, at, np.array([r.label for r in rows], np.int64))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score in [0, 1], predicted, n_lines, n_bad_lines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                x, size, row = line_features(data, offs)
                at = np.searchsorted(row, np.arange(j - i + 1))
                if m.weights is None:
                    score, bad = m.score(x, size, at), np.zeros(j - i)
                else:
                    good = m.lines(x, at)
                    score, bad = m.calibrated(mean_by(good, size, at)), np.add.reduceat((good < 0.5).astype(float), at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(score.astype(np.float64)),
                     pa.array(np.diff(at).astype(np.int64)), pa.array(bad.astype(np.int64))],
                    [b.schema.names[0], "score", "n_lines", "n_bad_lines"])
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, n_lines long, n_bad_lines long")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "n_lines", "n_bad_lines")
