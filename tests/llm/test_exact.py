"""Operators with one right answer against brute force, over edge cases and a small table."""

import random

import pytest

from postrisk.llm import queries as q
from postrisk.llm.op10_substring_dedup import substring_dedup
from postrisk.llm.op3_decontaminate import decontaminate
from postrisk.llm.op5_token_count import TokenCounter, token_count
from postrisk.llm.op6_near_dups import near_dups
from postrisk.llm.op7_url_filter import parse_rule, url_filter
from postrisk.llm.op8_mixing import mix
from postrisk.llm.op9_quality_rules import POLICIES, RULES, ablations, ledger, passes
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def odd_texts():
    r = random.Random(5)
    vocab = ["ab", "Ab", "cd", "é", "x1", "z", "the", "of", "Zürich", "a\u00a0b"]
    base = " ".join(r.choice(vocab) + str(r.randrange(60)) for _ in range(60))
    run = " ".join(["ha"] * 40)
    out = [None, "", " \n\t ", "one", "one", "ONE", "two words", base, base, base.replace(" ", "\n"), base + " tail",
           "head " + base, base[:len(base) // 2], run, run + " ha", "x " + run, "a b a b a b " * 12, "b a b a b a " * 12,
           "long" + "x" * 5000, "\u2003wide\u2003space\u0085next line", "line\nline\n\nline\n#*$%&|<>", "\n\n", "a\x1cb c",
           "\n".join([base] * 3), "tok " * 3000]
    for _ in range(60):  # edits of one text around the similarity limit
        w = base.split()
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    for _ in range(30):  # a shared passage in other words
        filler = " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(0, 30)))
        s = r.randrange(30)
        out.append(filler + " " + " ".join(base.split()[s:s + r.randrange(8, 30)]) + " " + filler)
    return out


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(len(texts) - i, t, "zz", None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(None, "null id " * 20, None, None), (None, texts[7], None, None), (3, texts[7], None, "s1"), rows[9], rows[9]]
    # extra columns with names that operators use inside
    return spark.createDataFrame([(*r, 1, "clash") for r in rows],
                                 "doc_id long, text string, lang string, source string, n long, g string").repartition(3)


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tables(odd, small):
    return [odd, small, small.where("false"), odd.where("text is null")]


def test_decontaminate(spark, odd, small):
    r = random.Random(1)
    w = odd_texts()[7].split()
    items = [(0, " ".join(w[5:30])), (1, "Two Words"), (2, None), (3, "..."), (4, " ".join(w[10:15])), (5, " ".join(w[5:30])),
             (6, "absent words only here and nowhere else in all of the texts"), (7, "tok tok tok tok tok tok tok tok tok tok tok")]
    items += [(10 + k, x) for k, x in enumerate(r.sample([t for t in odd_texts() if t], 10))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    for docs in tables(odd, small):
        for b in (bench, real, real.where("false")):
            got = decontaminate(docs, b).select("doc_id", "n_words", "n_hit", "n_items",
                                                q.items_digest().alias("d"), "contaminated")
            same(pairs(got, "*"), brute.decontaminate(pairs(docs, "doc_id", "text"), pairs(b, "item_id", "text")))


def test_near_dups(odd, small):
    for docs in tables(odd, small):
        for block in (256, 5) if docs is odd else (256,):  # small blocks force the straggler rounds
            got = near_dups(docs, words=2, block=block)
            same(pairs(got, "*"), brute.near_dups(pairs(docs, "doc_id", "text")))


def test_components(spark):
    from postrisk.llm.components import components
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] \
        + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules(odd, small):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in tables(odd, small):
        same(pairs(ledger(docs), "doc_id", *cols), [(i, *brute.rules(t)) for i, t in pairs(docs, "doc_id", "text")])


def test_ablations_follow_from_bits(small):
    book = ledger(small)
    bits = [r.bits for r in book.collect()]
    names = POLICIES["v2"]
    on = [[n for n in names if b >> RULES.index(n) & 1] for b in bits]
    for r in ablations(book, "v2").collect():
        assert r.n_failed == sum(r.rule in x for x in on)
        assert r.n_only_this == sum(x == [r.rule] for x in on)
        assert r.n_kept_without == sum(not set(x) - {r.rule} for x in on)
    assert book.where(passes("v2")).count() == sum(not x for x in on)


def test_substrings(odd, small):
    for docs in tables(odd, small):
        same(pairs(substring_dedup(docs, with_text=False), "*"), brute.substrings(pairs(docs, "doc_id", "text")))


def test_windows_with_one_fingerprint_are_verified():
    """Windows that share the first fingerprint only are different."""
    import numpy as np
    import pyarrow as pa
    from postrisk.llm import op10_substring_dedup as op10
    u, v = (lambda *x, t=t: np.array(x, t).tobytes() for t in (np.uint64, np.uint32))
    ids, ref = np.array([1, 2], np.int64).tobytes(), lambda *x: np.array(x, np.uint16).tobytes()
    t = pa.table({"part": pa.array([0, 0], pa.int32()), "block": [5, 6], "windows": [u(7, 8), u(7, 8)], "seconds": [v(1, 2), v(9, 2)],
                  "ids": [ids, ids], "owner": [ref(0, 0), ref(1, 1)]})
    back = op10._earlier(t)
    assert back.column("block").to_pylist() == [6] and back.column("payload")[0].as_py() == u(8) + v(2)
    text = " ".join(f"w{i}" for i in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int64()), pa.array([text])], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    block = sink.getvalue().to_pybytes()
    p = op10.Parsed(pa.array([text]), np.array([3]))
    for wrong, n in ((0, 14), (1, 0)):
        told = p.fp[2:4].tobytes() + (p.second(np.array([2, 3])) + np.uint32(wrong)).tobytes()
        got = op10._cut(False)(pa.table({"part": pa.array([None, 0], pa.int32()), "payload": [block, told]}))
        assert got.column("n_removed").to_pylist() == [n]


def test_word_marks_depend_on_bytes_alone(monkeypatch):
    import numpy as np
    from postrisk.llm import op10_substring_dedup as op10
    words = [b"a", b"ab", b"ba", b"a" * 50, b"a" * 49 + b"b", "é".encode(), b"ab"] * 3
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    marks = op10.word_marks(data, starts, ends)
    monkeypatch.setattr(op10, "MARK_BYTES", 7)
    assert (op10.word_marks(data, starts, ends) == marks).all()
    assert len(set(marks.tolist())) == len(set(words)) and len(set(zip(words, marks.tolist()))) == len(set(words))


def test_tokens(spark, odd, small):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(q.token_file())
    hard = ["<|endoftext|>hi<|startoftext|>", "a<|endoftext|>b", "<|endoftext|", "ΣΑΣ Σ", "İstanbul ǅ", "it's we'RE I'll 'd 't", "e\u0301é ﬁ",
            "123 ¼ ² 1\u0663", "!!!???... a__b", "日本語テキスト", "🙂🙂 👩‍👩‍👧", "\x00\x01", "a\u0085b\u200bc\u2028d\u1680e\x1ff", "'s's'S", "ſt Å", "x" * 3000]
    for docs in [*tables(odd, small), spark.createDataFrame(enumerate(hard), "doc_id long, text string")]:
        want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048)
                for i, t in pairs(docs, "doc_id", "text")]
        same(pairs(token_count(docs, q.token_file()), "*"), want)


def test_other_vocabularies_are_refused(spark, small):
    import public_tokenizers
    with pytest.raises(ValueError):
        token_count(small, public_tokenizers.path("byte_bpe_50k.json"))


def test_token_memo_is_bounded(monkeypatch):
    import json

    from postrisk.llm import op5_token_count as m
    monkeypatch.setattr(m, "MEMO_ENTRIES", 10)
    with open(q.token_file()) as f:
        c = TokenCounter(json.load(f))
    c.count(" ".join(f"word{i}x" for i in range(50)).replace("1", "q").encode())
    assert len(c.tokens) <= 10 and len(c.pieces) <= 10


def test_urls(spark):
    rules = [parse_rule(r) for r in [*q.URL_RULES, "block a.b.com/x", "allow a.b.com/x/y", "allow b.com/x/", "block org/deep/er/"]]
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://www.Example.com/en/1?x#y", "http://example.com/en", "https://example.com/en/",
            "ftp://m.example.net/es/a", "http://net/fr/", "http://xnet/fr/", "http://a.b.com/xyz", "http://a.b.com/x/y/z", "http://c.b.com/x/",
            "http://c.b.com/x", "http://q.org/deep/er/z", "http://q.org/deep//er/", "http://q.org", "http://user@example.com:80/en/", "a://b://com/",
            "http://example.com?/en/", "http://.com/", "http://com./", "http://a..com//", "http://ÄÖ.com/\nq"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[5], "x")], "page_id long, url string, rule string")
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for df in (pages, real, real.where("false")):
        same(pairs(url_filter(df, rules), "*"), [(i, *brute.judge_url(u, rules)) for i, u in pairs(df, "page_id", "url")])


def test_mixing(odd, small):
    for docs in tables(odd, small):
        rows = pairs(docs, "doc_id", "text", "source")
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(brute.blank_words(t))
        want = brute.mix_targets(sizes) if sizes else {}
        out = mix(docs, block_rows=16)
        got = pairs(out, "doc_id", "source", "size", "source_size", "target", "taken")
        same([(i, s, n) for i, s, n, *_ in got], [(i, s, len(brute.blank_words(t))) for i, t, s in rows])
        taken, largest = {}, {}
        for i, s, n, total, target, words in got:
            assert total == sizes[s] and target == pytest.approx(want[s])
            assert words <= 3 * n and (n == 0 or words % n == 0)
            taken[s] = taken.get(s, 0) + words
            largest[s] = max(largest.get(s, 0), n)
        for s in want:
            assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.6 * largest[s])
        same(got, pairs(mix(docs.repartition(5), block_rows=16), "doc_id", "source", "size", "source_size", "target", "taken"))


def test_mixing_splits_hot_ids(spark, monkeypatch):
    from postrisk.llm import op8_mixing as op8
    biggest = spark.sparkContext.accumulator(0)
    inner = op8.round_block

    def counted(block):
        biggest.add(int(block["n"].sum() > 80))
        return inner(block)

    monkeypatch.setattr(op8, "round_block", counted)
    rows = [(None, "same words in every row", "a")] * 900 + [(None, f"word {'x ' * (i % 9)}", "a") for i in range(300)] + [
        (i, f"other {'y ' * (i % 30)}", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs, block_rows=16).persist()
    assert out.count() == len(rows)
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"], r
    assert out.where("copies > 3").isEmpty()
    kinds = out.groupBy("doc_id", "size", "copies").count()
    again = mix(docs.repartition(7), block_rows=16).groupBy("doc_id", "size", "copies").count()
    assert kinds.exceptAll(again).isEmpty() and biggest.value == 0


def test_few_links_meet_by_broadcast_and_many_without(spark, monkeypatch):
    """Rounds of few links need no salted exchanges; both ways find the same components."""
    from postrisk.llm import components as c
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 200), (200, 300), (300, 200)]
    links = spark.createDataFrame(pairs, "a long, b long")
    few = c._small_star(c._large_star(links, True), True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in few and "BroadcastHashJoin" in few
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 300: 200}
    for bound in (c.BROADCAST_LINKS, 0):
        monkeypatch.setattr(c, "BROADCAST_LINKS", bound)
        got = c.components(links)
        assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
