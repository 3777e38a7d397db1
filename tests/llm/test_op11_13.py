"""Scores, conversation repair and spelling groups against brute force, and odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from postrisk.llm import attention_lm as lm
from postrisk.llm import op11_lm_score as op11
from postrisk.llm import op12_conversation_repair as op12
from postrisk.llm import op13_spelling_groups as op13
from postrisk.llm.queries import SUBWORD_FILE, token_file

HOSTILE = ["label", "n", "word", "row", "id", "text_hash", "_n", "c2", "kind", "near"]


# ---- 11 ----------------------------------------------------------------------

def test_gradients():
    r = np.random.default_rng(1)
    m = lm.AttentionLM(9)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64) + 0.1 * r.standard_normal(m.p[k].shape)
    x = r.integers(0, 9, (2, lm.WINDOW))
    x[0, :5] = -1
    t = r.integers(0, 9, (2, lm.STRIDE))
    t[1, -4:] = -1
    _, g = m.loss_gradients(x, t)
    for k in m.p:
        for at in list(np.ndindex(m.p[k].shape))[::max(1, m.p[k].size // 7)]:
            old, eps, got = m.p[k][at], 1e-4, []
            for d in (eps, -eps):
                m.p[k][at] = old + d
                got.append(m.loss_gradients(x, t)[0])
            m.p[k][at] = old
            assert abs((got[0] - got[1]) / (2 * eps) - g[k][at]) < 2e-4, (k, at)


def test_windows_score_each_token_once_from_the_past_only():
    r = np.random.default_rng(2)
    m = lm.AttentionLM(12)
    m.p["w2"] = r.standard_normal(m.p["w2"].shape).astype(np.float32)
    c = r.integers(0, 12, 230)
    bounds = np.array([0, 1, 33, 100, 230])
    x, t, place = lm.windows(c, bounds, 12)
    assert sorted(place[place >= 0]) == list(range(230)) and (t[place >= 0] == c[place[place >= 0]]).all()
    lp = m.log_probs(x, t)
    flat = np.empty(230)
    flat[place[place >= 0]] = lp[place >= 0]
    # one position at a time, its window's later inputs gone
    for a, b in zip(bounds, bounds[1:]):
        seq = [12, *c[a:b]]
        for j in range(b - a):
            lo = j // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE)
            win = [-1] * lm.WINDOW
            for i in range(max(lo, 0), j + 1):
                win[i - lo] = seq[i]
            alone = np.full((1, lm.STRIDE), -1)
            alone[0, j % lm.STRIDE] = c[a + j]
            assert abs(m.log_probs(np.array([win]), alone)[0, j % lm.STRIDE] - flat[a + j]) < 1e-4
    every = np.array([[m.log_probs(x[:1], np.full((1, lm.STRIDE), k))[0, 3]] for k in range(12)])
    assert abs(np.exp(every).sum() - 1) < 1e-5


def brute_base(rows):
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    words = lambda t: (t or "").encode().translate(op11._LOWER).split()
    c = Counter(w for t in train for w in words(t))
    n, v, ends = sum(c.values()) + len(train), len(c) + bool(train), len(train)
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, base))
    return out


@pytest.mark.parametrize("head", [op11.HEAD, 5])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(op11, "HEAD", head)
    monkeypatch.setattr(op11, "CHUNK_WORDS", 50)
    monkeypatch.setattr(op11, "MEMO_ENTRIES", 40)
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8))) for _ in range(80)]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for k in range(60)]
    rows += [(None, "abc Zzz"), (7, None), (7, None), (61, ""), (62, " \n\t"), (63, "new one \x0bx " * 300)]
    df = spark.createDataFrame([(i, t, *[1] * len(HOSTILE)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in HOSTILE))
    corpus = op11.learn(df, token_file(SUBWORD_FILE), train_texts=50, steps=30)
    got = op11.lm_scores(df, corpus).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for a, b in zip(sorted((tuple(x) for x in got), key=key), sorted(brute_base(rows), key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
    # text by text gives the same score as in chunks
    top = corpus.counts.orderBy("word").collect()
    s = op11.Scorer(corpus.raw, {bytes(x.word): x.n for x in top}, corpus.ids, corpus.model, corpus.tokens, corpus.types)
    alone = {t: s.chunk([op11.words_of(t)])[0][0] for _, t in rows}
    for x in got:
        assert any(i == x.doc_id and abs(alone[t] - x.score) < 1e-3 for i, t in rows)
    assert all(x.score < 0 for x in got)


def test_scores_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    corpus = op11.learn(df, token_file(SUBWORD_FILE))
    assert op11.lm_scores(df, corpus).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    got = op11.lm_scores(one, op11.learn(one, token_file(SUBWORD_FILE))).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0) and got.score < 0


def test_held_out_texts_are_likelier_than_by_counts_of_characters(spark):
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = op11.lm_scores(docs, op11.learn(docs, token_file(SUBWORD_FILE), steps=150)).where("held_out").toPandas()
    assert got.score.sum() > 1.15 * got.base_score.sum()  # log10 values below 0: at most 15 % worse than known whole words


@pytest.mark.parametrize("part", [None, 12])
def test_attention_is_fitted_on_every_window_of_every_training_text(spark, monkeypatch, part):
    r = random.Random(4)
    seqs = [(k * 7919 - 20000, [r.randrange(30) for _ in range(r.choice((1, 31, 33, 700)))]) for k in range(14)]
    table = np.arange(30) % 12
    start = lm.AttentionLM(12)
    n = [-(-len(ids) // lm.STRIDE) for _, ids in seqs]
    monkeypatch.setattr(op11, "PART_WINDOWS", part or sum(n))
    parts = -(-sum(n) // op11.PART_WINDOWS)

    def plain(model, some):
        flat = [table[np.array(ids)] for _, ids in sorted(some)]
        x, t, _ = lm.windows(np.concatenate(flat), np.cumsum([0, *map(len, flat)]), 12)
        return lm.AttentionLM.of(12, model.prior, {k: v.copy() for k, v in model.p.items()}).fit(x, t, steps=max(3, -(-len(x) // lm.BATCH))), len(x)
    want, seen = plain(start, [s for s in seqs if s[0] % parts == 0])
    if parts > 1:
        each = [plain(want, some) for p in range(parts) if (some := [s for s in seqs if s[0] % parts == p])]
        seen = sum(k for _, k in each)
        want = want.with_vector(sum(m.vector() * k for m, k in each) / seen)
    assert seen == sum(n) and (parts > 1) == bool(part)
    df = spark.createDataFrame(seqs, "k long, ids array<int>")
    for rows in (df.repartition(5), df.coalesce(1)):
        got = op11.fit_attention(rows, table, start, sum(n), 3)
        assert np.abs(got.vector() - want.vector()).max() < 1e-4


def test_words_cut_together_have_the_ids_they_have_alone():
    cut = op11.cutter_for(open(token_file(SUBWORD_FILE), "rb").read())
    r = random.Random(6)
    words = ["a", "don't", "'s", "12x3", "...", "\u00a0", "x\u00a0", "\u3000\u3000y", "\u2028", "\x1c", "\x00", "\x85", "caf\u00e9", "e\u0301", "\U0001f600!", "1.5e-3", "_", "'"]
    words += ["".join(r.choice("ab'9.\u00a0\u2003\x1f\u0301\u4e2d_-") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    words = [w.encode() for w in words if w]
    flat, n = cut.many(words)
    ends = np.cumsum(n)
    assert len(n) == len(words) and [list(flat[e - k:e]) for e, k in zip(ends, n)] == [cut(w) for w in words]
    assert [len(x) for x in cut.many([])] == [0, 0]


def test_the_texts_learnt_from_are_not_cut_again_to_score_them(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"one two {k} " * 9) for k in range(20)], "doc_id long, text string")
    same = df.select("*")
    corpus = op11.learn(df, token_file(SUBWORD_FILE), steps=5)
    want = sorted(map(tuple, op11.lm_scores(same, corpus).collect()))  # another table is cut
    monkeypatch.setattr(op11, "cut_texts", None)
    assert sorted(map(tuple, op11.lm_scores(df, corpus).collect())) == want


# ---- 12 ----------------------------------------------------------------------

def brute_repair(rows):
    """Least (cost, audit) by states, every edit tried."""
    def inserted(best):
        b = dict(best)
        for _ in range(2):
            for s, (c, a) in list(b.items()):
                t, v = (2, 3, 3, 2)[0] if s != 2 else 3, (c + 3, a + "I")
                if t not in b or v < b[t]:
                    b[t] = v
        return b
    best = {0: (0, "")}
    for r in rows:
        after = {}
        for s, (c, a) in inserted(best).items():
            moves = [(s, c + 4, "D")]
            if not r.gone:
                t, want = c + 3 * (r.fault == op12.CUT), "uuau"[s]
                if s == 0 and r.role[:1] == "s":
                    moves.append((1, t, "K"))
                moves.append((2 if want == "u" else 3, t + 3 * (r.role[:1] != want), "K" if r.role[:1] == want else "R"))
            for s2, c2, op in moves:
                if s2 not in after or (c2, a + op) < after[s2]:
                    after[s2] = (c2, a + op)
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def test_alignment_equals_all_edits():
    r = random.Random(5)
    for n in [*range(9)] * 120 + [40] * 10 + [150] * 2:
        rows = [op12.Row(r.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", ""]), "x", r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        assert op12.whole(rows) == brute_repair(rows)


def brute_conversations(rows):
    import hashlib
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        by[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for c, rs in by.items():
        rs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, made = set(), []
        for _, role, text in rs:
            made.append(op12.Row(role, text, op12.fault(role, text, (role, text) in seen)))
            seen.add((role, text))
        cost, audit = brute_repair(made)
        f = [x.fault for x in made]
        turns = {x[0] for x in rs if x[0] is not None}
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count(1), f.count(2), f.count(3),
                  sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:])), cost, audit,
                  hashlib.sha256("\n".join(op12.rebuilt(made, audit)[0]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [op12.BLOCK, 4])
def test_repair(spark, block):
    """Conversations cut into blocks of four rows come out as whole ones do."""
    r = random.Random(6)
    text = ["Yes.", "no", "Why?\n", "", " ", None, "x.y", "Ok!", "é."]
    rows = [(c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", "system", None, "user", "assistant", ""]), r.choice(text) if r.random() < 0.6 else f"t{t}.")
            for c in [*range(25), None] for t in range(r.choice([1, 2, 5, 9, 30]))]
    rows += [(99, None, "user", "same.")] * 9 + [(98, 5, None, None)]
    df = spark.createDataFrame([(*x, *[1] * len(HOSTILE)) for x in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` int" for c in HOSTILE))
    got = {x[0]: tuple(x[1:]) for x in op12.repair(df, block).collect()}
    assert got == brute_conversations(rows)
    assert op12.repair(df.limit(0), block).count() == 0


# ---- 13 ----------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("levels", [op13.LEVELS, 6])
def test_neighbours(spark, levels):
    r = random.Random(8)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(200)}
    words |= {"a" * k for k in (5, 6, 7, 22, 23, 24, 25, 26)} | {"a" * 23 + "b", "a" * 24 + "b", "b" + "a" * 24, "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499}
    got = op13.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), levels).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == {(a, b) for a in words for b in words if near(a, b)}


def brute_groups(rows):
    import re
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], w, n[w], len(close), n[form[w]] if form[w] else None]
    for w in n:
        while form[out[w][1]]:
            out[w][1] = form[out[w][1]]
    return {w: tuple(x) for w, x in out.items()}


def test_groups(spark):
    r = random.Random(9)
    words = ["table", "tables", "tablè", "täble", "stable", "cable", "Cables", "ÉTABLE", "étable", "wörter", "worter", "ab", "abcd", "x×y÷z", "naïve—naive", "жtable", "tabel"]
    rows = [(k if k % 7 else None, " ".join(r.choice(words[:1 + r.randrange(len(words))]) for _ in range(40))) for k in range(60)]
    rows += [(3, None), (4, ""), (5, "--- 12"), (6, "q" * 5000), (7, "q" * 5000), (8, "q" * 5000 + " " + "q" * 4999), (9, "q" * 4999 + " " + "q" * 4999), *[(11, "repeat repeal")] * 4]
    df = spark.createDataFrame([(i, t, *[1] * len(HOSTILE)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in HOSTILE))
    got = {x[0]: tuple(x[1:]) for x in op13.spelling_groups(df).collect()}
    assert got == brute_groups(rows)
    assert op13.spelling_groups(df.limit(0)).count() == 0


# ---- redaction reaches a fixed point -------------------------------------------

class Nothing:
    """A tagger that finds nothing."""
    k = 9

    def emissions(self, c):
        return np.zeros((*c.shape, self.k), np.float32)

    def decode(self, scores, n):
        return [np.zeros(int(x), np.int64) for x in n]


def test_neighbouring_numbers():
    from postrisk.llm import op4_pii as op4
    cards = "4465758382889437 4465758382889437"
    texts = [cards, cards.replace(" ", " 12 "), "4111 1111 1111 1111 5500 0000 0000 0004", "10.0.0.1 +1 (826) 555-4081", "+1 (826) 555-4081 10.0.0.1",
             "+44 20 7946 0958 +44 20 7946 0958", "1.2.3.4.5", "a@b.co 4465758382889437-1", None, "", "no numbers", "7 " * 3000]
    for t, out in zip(texts, op4.redacted_texts(Nothing(), texts)):
        assert out is None or not any(op4.base_spans(out)), (t, out)
    (base, added), = op4.find(Nothing(), [cards])
    assert not any(base) and added[2] == [(0, 16), (17, 33)]


@pytest.mark.parametrize("name", ["label", "place", "__id", "__text", "row", "text_hash", "of", "key", "chosen"])
def test_training_ignores_other_columns(spark, name):
    from pyspark.sql import functions as F

    from postrisk.llm import op2_quality_crf as op2
    from postrisk.llm import op4_pii as op4
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn(name, F.lit(1))
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert op2.quality(docs, op2.train(docs, labels, train_docs=40)).count() == docs.count()
    assert op4.personal_data(docs, op4.train(docs, train_windows=20, steps=1)).count() == docs.count()
