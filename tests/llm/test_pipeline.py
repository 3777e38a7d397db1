"""The pipeline: every stage's decisions against the operators and brute force."""

import corpus_pipeline as p
from postrisk.llm import op2_quality_crf as crf
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = [f for _, f in p.STAGES]

    one = p.write_cut(stages[0](spark, docs, SF), "t1")
    assert one.columns == p.COLUMNS
    scored = crf.quality(docs, crf.train(docs, labels))
    assert ids(one) == ids(scored.where("predicted = 1"))

    rows = [tuple(r) for r in one.select("doc_id", "text").collect()]
    two = p.write_cut(stages[1](spark, one, SF), "t2")
    assert ids(two) == sorted(i for i, _, _, kept in brute.near_dups(rows, k=5) if kept)

    rows = [tuple(r) for r in two.select("doc_id", "text").collect()]
    three = p.write_cut(stages[2](spark, two, SF), "t3")
    assert ids(three) == sorted(r[0] for r in brute.decontaminate(rows, bench) if not r[5])

    four = p.write_cut(stages[3](spark, three, SF), "t4")
    assert ids(four) == ids(three) and four.columns == p.COLUMNS
    from postrisk.llm.op4_pii import base_spans
    for r in four.collect():
        assert not any(base_spans(r.text)) and r.n_chars == len(r.text)

    five = stages[4](spark, four, SF).collect()
    assert all(r.taken == r.copies * r["size"] and 0 < r.copies <= 3 for r in five)
    assert len({r.doc_id for r in five}) == len(five)


def test_edges(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "s", 0), (1, "", "x", "s", 0), (2, None, None, None, 5),
                                 (3, "word " * 60, "en", "s", 1), (3, "word " * 60, "en", "s", 1), (None, "word " * 60, "en", None, 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for name, stage in p.STAGES:
            docs = p.write_cut(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
        docs.count()


def test_decisions_hold_for_rows(spark):
    """Null and shared ids: each row is judged by its own text, and comes out of the mix once."""
    from collections import Counter

    from postrisk.llm import op4_pii
    from postrisk.llm.common import read
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def table(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], schema).repartition(3)

    def rows(df):
        return Counter((r.doc_id, r.text, r.source) for r in df.collect())

    def words(k, n=40):
        return " ".join(f"w{k}x{j}" for j in range(n))

    # mixing: equal ids, null ids and wholly equal rows
    given = [(7, words(k, 5 + k), "s") for k in range(30)] + [(None, words(k, 9), "t") for k in range(20)] + [(1, words(1), "s")] * 4
    out = p.mixing(spark, table(given), sf)
    got = out.collect()
    assert not rows(out) - Counter(given)
    by = {s: sum(len(t.split()) for _, t, x in given if x == s) for s in "st"}
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert all(r["size"] == len(r.text.split()) and r.taken == r.copies * r["size"] and r.source_size == by[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.6 * 40

    # near copies: equal rows leave one, null-id copies go, another text under the id stays
    given = [(3, words(3), "s")] * 5 + [(3, words(4), "s"), (None, words(3), "s"), (None, words(5), "s"), (None, words(5), "s"), (2, words(4), "s"),
                                        (9, "", "s"), (9, "", "s"), (8, "", "s"), (9, None, "s"), (None, "", "s"), (None, "", "s")]
    assert rows(p.near_duplicates(spark, table(given), sf)) == Counter(
        [(3, words(3), "s"), (2, words(4), "s"), (None, words(5), "s"), (9, "", "s"), (8, "", "s"), (9, None, "s"), (None, "", "s"), (None, "", "s")])

    # decontamination: a null-id row with a benchmark window goes, clean texts under a bad row's id stay
    bench = max((r.text for r in read(spark, sf, "benchmark").collect() if r.text), key=len)
    given = [(None, f"begin {bench} end", "s"), (None, words(6), "s"), (4, bench, "s"), (4, words(7), "s"), (4, words(7), "s")]
    assert rows(p.decontamination(spark, table(given), sf)) == Counter([given[1], given[3], given[4]])

    # quality: by row, as the operator scores the text
    docs = read(spark, sf, "documents")
    odd = docs.withColumn("doc_id", p.F.when(p.F.col("doc_id") % 3 == 1, p.F.col("doc_id")).when(p.F.col("doc_id") % 3 == 2, p.F.lit(5)))
    model = crf.train(odd, read(spark, sf, "labels"))
    good = {r.doc_id for r in crf.quality(odd.select(p.F.col("text").alias("doc_id"), "text"), model).where("predicted = 1").collect()}
    all_rows = rows(odd)
    assert rows(p.quality(spark, odd, sf)) == Counter({r: n for r, n in all_rows.items() if r[1] in good})
    assert rows(op4_pii.redacted_table(odd, op4_pii.train(odd))).total() == all_rows.total()
