"""Operators with trained models and extraction: fixtures, held-out accuracy, gradients, edge cases."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrisk.llm import op2_quality_crf as crf
from postrisk.llm import op4_pii as pii
from postrisk.llm.char_tagger import Tagger, encode
from postrisk.llm.op1_html_extract import extract, host_paths, main_text
from tests.llm.test_exact import SF, odd, small  # noqa: F401  (fixtures)

# ---- HTML ----

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>x</article>";</script></head><body>
<div id="cookie-notice">We use cookies</div><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="layout row-{n}"><div class="post-body"><h2>Title {n} &amp; more</h2><p>First&nbsp;one,   with <b>bold</b>
text.<p>Second &eacute;&#233;&#x41; one<br>third line<div class="ad-slot">Buy now</div><ul><li>item <a href="x>y">link</a><li>two</ul>
<form><p>Subscribe</p><input name=q></form><!-- no > comment --><table><tr><td>cell 1<td>cell 2</table></div>
<div class="sidebar"><p>{long}</p></div><div id="comments"><p>{long}</p></div></div><footer>&copy; F</footer></body></html>"""
WANT = "Title {n} & more\nFirst one, with bold text.\nSecond ééA one\nthird line\nitem link\ntwo\ncell 1\ncell 2"


def test_extraction_by_host_path(spark):
    long = "reader words, many of them, again and again. " * 30
    pages = [(i, f"http://a.example/{i}", SITE.format(n=i, long=long), "x") for i in range(6)]
    # a page whose largest container is not its host's article
    pages += [(6, "http://a.example/x", SITE.format(n=6, long="s").replace("</div>\n<div class=\"sidebar\">", f"</div><section><p>{'aside words ' * 40}</p></section><div class=\"sidebar\">"), "x")]
    pages += [(7, "http://b.example/", "<main><p>only this</p></main>", "x"), (8, None, "<p>no url", "x"), (9, "http://a.example/", None, "x"),
              (9, "http://a.example/", None, "x"), (None, "http://c.example", "", None), (10, "http://d.example/", "plain &lt; text", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in main_text(df).collect()))
    want = [(-1, "", 0), *[(i, WANT.format(n=i), len(WANT.format(n=i))) for i in range(7)], (7, "only this", 9), (8, "no url", 6), (9, "", 0), (9, "", 0),
            (10, "plain < text", 12)]
    assert got == want
    assert {r.host: r.path for r in host_paths(df).collect()}["a.example"] == "html/body/div.layout.row-0/div.post-body"
    assert main_text(df.where("false")).count() == 0


def test_extraction_of_the_tables_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body))
        assert extract(r.html, None)[0] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("inner, tag", [
    ("<h1>Title</h1><p>{a}</p><section><p>{b}</p></section><section><p>{c}</p></section>", "article"),
    ("<h1>Title</h1><div class='body'><p>{a}</p><p>{b}</p><p>{c}</p></div>", "article"),
    ("<h1>Title</h1><p>{a}</p><ul><li>{b}</li><li>{c}</li></ul>", "div"),
    ("<h1>Title</h1><p>{a}</p><blockquote><p>{b}</p><p>{c}</p></blockquote>", "body")])
def test_extraction_keeps_what_surrounds_a_dominant_part(inner, tag):
    from postrisk.llm.op1_html_extract import Page, votes
    parts = {"a": "lead " * 40, "b": "long words " * 270, "c": "other words " * 80}
    links = "<div class='more'><a href='/1'>another page of the site</a> <a href='/2'>one more page</a></div>"
    page = f"<{tag}>{inner.format(**parts)}</{tag}>"
    page = f"<html>{page}</html>" if tag == "body" else f"<html><body><div class='page'>{page}{links}</div></body></html>"
    want = "\n".join(["Title", *[x.strip() for x in parts.values()]])
    assert extract(page, None)[0] == want
    v = votes(Page(page))
    path = max(v, key=lambda p: (v[p], p))
    assert path.endswith(tag) and extract(page, path) == (want, True)


LONG, SIDE = "body words of the article. " * 20, "side words. " * 10


@pytest.mark.parametrize("inner, want", [
    ("<div class='has-sidebar'><article><h1>T</h1><p>{a}</article><div class='sidebar'><p>{s}</div></div>", "T\n{a}"),
    ("<div id='content-sidebar-wrap'><main><h1>T</h1><p>{a}</main><aside>{s}</aside></div>", "T\n{a}"),
    ("<form id='f'><div class='c'><h1>T</h1><p>{a}<p>b<p>c</div></form>", "T\n{a}\nb\nc"),
    ("<form id='f'><div class='site-menu-wrap'><main><h1>T</h1><p>{a}</main></div></form>", "T\n{a}"),
    ("<article><h1>T</h1><div class='share-price'><p>{a}</div><section class='related-work'><p>{s}</section><p class='alert'>x"
     "<div class='related-posts'>no</div><div class='share-buttons'>no</div></article>", "T\n{a}\n{s}\nx"),
    ("<article><header class='entry-header'><h1>T</h1><div class='share'>no</div></header><p>{a}</p><header><p>no</header></article>", "T\n{a}"),
    ("<article><div class='post-header'><h2>T</h2></div><p>{a}</p></article><div class='sidebar'><article>{a}{a}</article></div>", "T\n{a}"),
    ("<div class='menu'><article><p>teaser</article></div><p>{a}", "{a}"),
    ("<div id='comments'><article><p>{a}</article></div><p>short", "short"),
    ("<article></article><form><p>Subscribe<p>to<p>this</form>", "")])
def test_marks_are_judged_by_what_they_hold(inner, want):
    page = ("<html><body><div id='cookie-notice'>We use cookies</div><header class='site'><h1>Site</h1></header>"
            f"{inner.format(a=LONG, s=SIDE)}<footer>F</footer></body></html>")
    assert extract(page, None)[0] == want.format(a=LONG.strip(), s=SIDE.strip())


@pytest.mark.parametrize("source", ["<", "<p" * 20000, "<div>" * 20000 + "deep", "<a href='x>y", "<!-- open" * 2000, "<script>never", "</div>" * 20000,
                                    "<b><p>" * 10000, "\x00�&#0;&#1114112;&bogus;", "<td>1<td>2", "<p>a</p></p></body></html>b"])
def test_broken_pages(source):
    text, _ = extract(source, "html/body")
    assert isinstance(text, str)


# ---- quality ----

def _brute_marginals(u, trans):
    from itertools import product
    total, good = 0.0, np.zeros(len(u))
    for y in product((0, 1), repeat=len(u)):
        w = np.exp(sum(u[t] * y[t] for t in range(len(u))) + sum(trans[y[t - 1], y[t]] for t in range(1, len(u))))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(2)
    at = np.array([0, 1, 6, 8, 15])
    u, trans = r.normal(size=15), r.normal(size=(2, 2))
    got = crf.Chain(at).marginals(u, trans)
    for a, b in zip(at[:-1], at[1:]):
        np.testing.assert_allclose(got[a:b], _brute_marginals(u[a:b], trans), atol=1e-10)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = crf.quality(docs, crf.train(docs, labels)).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(out) > 80
    assert np.mean([r.quality == r.predicted for r in out]) > 0.95


def test_quality_edges(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = crf.train(odd, labels, train_docs=20, train_lines=4)
    out = crf.quality(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.n_lines == 1 and r.doc_id in (None,)}) <= 2
    assert [(r.doc_id, r.score) for r in out if r.doc_id] and crf.quality(odd.where("false"), model).count() == 0
    for few in (labels.where("false"), labels.where("quality = 1")):
        m = crf.train(odd, few)
        s = {r.score for r in crf.quality(odd, m).collect()}
        assert len(s) == 1 and 0 < s.pop() < 1


def test_held_out_rows_never_train(spark, small):  # noqa: F811
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = crf.train(small, labels)
    flipped = labels.withColumn("quality", F.when(crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = crf.train(small, flipped)
    np.testing.assert_allclose(a.weights, b.weights)


# ---- personal data ----

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, rule in RULES:
        for m in re.finditer(rule, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p[-50:]) <= 255 and not p[:-50].strip("0") for p in m[0].split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0,
                  "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def odd_strings():
    r = random.Random(8)
    out = ["a@b.c@d.e", "a@b@c.d", "x.y@z..w", "@a.b", "a@.b", "é.a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "001.002.3.0004", "1..2.3.4",
           "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0123.", "+1--", "++49 30 1234567", "5" * 200, "4111111111111111 " * 3, "٣.1.1.1.1"]
    out += ["".join(r.choice("019 .-+@()aé\n4_") for _ in range(r.randrange(5, 80))) for _ in range(3000)]
    return out + [t for t, _ in pii.generated(300, seed=5)]


def test_base_spans_against_plain_search():
    for t in odd_strings():
        assert pii.listed(pii.base_spans(t)) == brute_spans(t), t


@pytest.mark.parametrize("t", ["9" * 100000, "1." * 50000, "a" * 100000 + "@", "a@" * 50000, "+1" * 50000, "1 " * 50000])
def test_base_spans_take_linear_time(t):
    pii.base_spans(t)


def test_tagger_gradients():
    rows = pii.generated(6)
    c = np.stack([encode(t, pii.WINDOW) for t, _ in rows])
    tags = np.zeros(c.shape, np.int64)
    for k, (_, x) in enumerate(rows):
        tags[k, :len(x)] = x
    m = Tagger(4, hidden=6, embed=5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, grad = m.loss(c, tags)
    r = np.random.default_rng(0)
    for name, p in m.p.items():
        i = tuple(r.integers(0, s) for s in p.shape) if name != "E" else (int(c[0, 0]), 1)
        p[i] += 1e-3
        up = m.loss(c, tags)[0]
        p[i] -= 2e-3
        down = m.loss(c, tags)[0]
        p[i] += 1e-3
        assert grad[name][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3), name


@pytest.fixture(scope="module")
def tagger(small):  # noqa: F811
    return pii.train(small, train_windows=800)


def test_tagger_on_unseen_windows(tagger):
    rows = pii.generated(300, seed=77)
    hits = wrong = missed = 0
    for (_, tags), got in zip(rows, pii.tag(tagger, [t for t, _ in rows])):
        want = {((x - 1) // 2, i) for i, x in enumerate(tags) if x % 2}
        got = {(k, a) for k, a, _ in got}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert 2 * hits / (2 * hits + wrong + missed) > 0.9


def test_windows_are_reconciled(tagger):
    """A span is found wherever it stands to the window borders, and far text doesn't matter."""
    for shift in range(0, 200, 7):
        text = "word 7 " * 20 + "w" * shift + " call (202) 555-0123 now " + "7 word " * 30
        (_, added), = pii.find(tagger, [text])
        assert [text[a:b] for a, b in added[3]] == ["(202) 555-0123"], shift


def test_personal_data_edges(spark, odd, small, tagger):  # noqa: F811
    extra = spark.createDataFrame(enumerate(odd_strings()[:200] + [None, ""]), "doc_id long, text string")
    for df in (odd, small, extra, odd.where("false")):
        out = pii.personal_data(df, tagger, redacted=True).collect()
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(repr, [(r.doc_id, r.base) for r in out])) == sorted(map(repr, [(i, brute_spans(t or "")) for i, t in texts]))
        for r in out:
            assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
            assert r.base.count("email") == r.n_email and r.base.count("phone") == r.n_phone
            assert r.redacted is None or not pii.base_spans(r.redacted)[0]
        assert pii.redacted_table(df, tagger).count() == len(texts)


def test_redaction():
    t = "mail a@b.co or +1 202 555 0123, ok"
    assert pii.redact(t, pii.base_spans(t)) == "mail <email> or <phone>, ok"
    assert pii.redact("no data", [[], [], [], []]) == "no data"


def test_training_without_examples(spark):
    t = pii.train(spark.createDataFrame([(1, None), (2, "no numbers")], "doc_id long, text string"), train_windows=50, steps=5)
    assert pii.find(t, ["", "x 1"])
