"""Owen values, subword pieces, order-statistic cuts, keyed ingest state, fits on all rows."""

import random

import pytest
from pyspark.sql import functions as F

from postrisk.operators import explain, models, ranking, subwords


def brute_owen(value, lo, n, shown, share, out):
    if n == 1:
        out[lo] = out.get(lo, 0.0) + share * (value(shown | {lo}) - value(shown))
        return
    h = n // 2
    for a, b in ((lo, lo + h), (lo + h, lo)):
        for other in (set(), set(range(b, b + h))):
            brute_owen(value, a, h, shown | other, share / 2, out)


def test_owen_coefficients_split_the_whole_gain():
    r = random.Random(1)
    score = {m: r.random() for m in range(1 << 8)}
    want = {}
    brute_owen(lambda s: score[sum(1 << i for i in s)], 0, 8, set(), 1.0, want)
    got = {j: sum(c * score[m] for m, c in by.items()) for j, by in explain.owen_coefficients(3).items()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(score[255] - score[0])


def test_owen_sums_and_forms(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t", "a", "", "b b c zz", " ".join("abc" for _ in range(300))]
    posts = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "post_id string, text string")
    r = random.Random(2)
    odds = spark.createDataFrame([(c, r.uniform(-1, 1)) for c in "abcdefghijklmnopqrst"] + [("abc", 0.01)], "term string, log_odds double")
    bias = spark.createDataFrame([(0.3,)], "bias double")

    def scorer(df):
        k = df.withColumn("_key", F.concat_ws(":", "post_id", "coalition"))
        return k.join(explain.linear_scores(k, odds, bias, key="_key"), "_key")
    a = {(x.post_id, x.pos): (x.word, round(x.weight, 9)) for x in explain.owen(posts, scorer, levels=3).collect()}
    b = {(x.post_id, x.pos): (x.word, round(x.weight, 9)) for x in explain.linear_owen(posts, odds, bias, levels=3).collect()}
    assert a == b and len(a) == sum(len(t.split()) for t in texts)
    p = {x.post_id: x.P_hoax for x in explain.linear_scores(posts, odds, bias).collect()}
    for k, t in enumerate(texts):
        assert sum(w for (i, _), (_, w) in a.items() if i == str(k)) == pytest.approx(p[str(k)] - p["2"] if t else 0, abs=1e-7)


def test_longest_match_pieces(spark):
    vocab = spark.createDataFrame([(p, i + 4) for i, p in enumerate(["un", "##aff", "##able", "##a", "##f", "##ff", "u", "hug", "##s", "x" * 8])], "piece string, id int")
    posts = spark.createDataFrame([("1", "unaffable hugs hugz"), ("2", ""), ("3", "u " * 200), ("4", "x" * 101 + " " + "x" * 8)], "post_id string, text string")
    got = {}
    for x in subwords.subword_pieces(posts, vocab).orderBy("post_id", "pos", "part").collect():
        got.setdefault(x.post_id, []).append(x.piece)
    assert got == {"1": ["un", "##aff", "##able", "hug", "##s", "[UNK]"], "3": ["u"] * 200, "4": ["[UNK]", "x" * 8]}
    e = {x.post_id: x for x in subwords.encode_subwords(posts, vocab, max_len=10).collect()}
    assert e["1"].input_ids == [2, 4, 5, 6, 11, 12, 1, 3, 0, 0] and e["1"].attention_mask == [1] * 8 + [0] * 2
    assert e["2"].input_ids == [2, 3] + [0] * 8 and e["3"].n_pieces == 200 and e["3"].input_ids == [2] + [10] * 8 + [3]


def test_counted_pieces_cover_every_character(spark):
    posts = spark.createDataFrame([("1", "abc abd abd"), ("2", "xyz")], "post_id string, text string")
    vocab = subwords.count_pieces(posts, size=17)
    pieces = [x.piece for x in vocab.orderBy("id").collect()]
    assert len(pieces) == 13 and {"a", "x", "##b", "##c", "##d", "##y", "##z"} <= set(pieces) and "abd" in pieces
    assert "[UNK]" not in {x.piece for x in subwords.subword_pieces(posts, vocab).collect()}


@pytest.mark.parametrize("bins", [1, 7, ranking.CUT_BINS])
def test_rank_cuts(spark, bins):
    r = random.Random(3)
    rows = [(r.choice("aab"), r.choice([0.0, 0.25, r.random(), 0.999999]), f"k{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, _u double, _key string")
    ranks = spark.createDataFrame([("a", 0, 17), ("b", 1, sum(x[0] == "b" for x in rows))], "g string, n1 long, n2 long")
    got = {x.g: x for x in ranking.rank_cuts(df, "g", ranking.rank_histogram(df, "g", bins=bins), ranks, ["n1", "n2"], bins=bins).collect()}
    by = {g: sorted((u, k) for h, u, k in rows if h == g) for g in "ab"}
    assert got["a"].n1 is None and tuple(got["a"].n2) == by["a"][16]
    assert tuple(got["b"].n1) == by["b"][0] and tuple(got["b"].n2) == by["b"][-1]


def test_split_moves_no_text(spark, tmp_path):
    from postrisk.operators import dataset
    spark.range(400).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 5 == 0).cast("int").alias("label"),
                            F.repeat(F.lit("text "), 9).alias("text")).write.parquet(f"{tmp_path}/posts")
    out = dataset.stratified_split(spark.read.parquet(f"{tmp_path}/posts"))
    assert {(x.label, x.split): x["count"] for x in out.groupBy("label", "split").count().collect()}[(1, "test")] > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_ingest_batches_never_read_the_sink(spark, tmp_path):
    """Ids seen in earlier batches stay out though their rows were taken from the sink."""
    import shutil

    from postrisk.streaming.ingest import seed_sink, stream_ingest
    cols = "collection_type string, post_id string, query string, text string, scraped_at_utc string, row_ord long"
    for k, ids in enumerate([["1", "2", "2"], ["2", "3", "9"], ["1", "4", None]]):
        spark.createDataFrame([("t", i, "q", f"{k}-{j}", "2024-01-01 00:00:00", 10 * k + j) for j, i in enumerate(ids)], cols).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
    schema = spark.read.parquet(f"{tmp_path}/all/0").schema
    seed_sink(spark.createDataFrame([("t", "9", "q", "old", "2024-01-01 00:00:00", 0)], schema), f"{tmp_path}/sink")
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(3):
        shutil.copytree(f"{tmp_path}/all/{k}", f"{tmp_path}/in/{k}")
        stream_ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/sink", f"{tmp_path}/ck").awaitTermination()
        parts = sorted(p for p in (tmp_path / "sink").iterdir() if p.name.startswith("_batch=") and p.name != "_batch=-1" and not p.name.startswith("."))
        for p in parts:  # read, then emptied: later batches can't look ids up here
            seen += [(r.post_id, r.text) for r in spark.read.schema(schema).parquet(str(p)).collect()]
            shutil.move(str(p), f"{tmp_path}/gone-{k}-{p.name}")
    assert sorted(seen, key=str) == sorted([("1", "0-0"), ("2", "0-1"), ("3", "1-1"), ("4", "2-1"), (None, "2-2")], key=str)


def test_fit_counts_every_row(spark):
    """The vocabulary and idf see all rows, the trees a sample."""
    rows = [(str(i), f"w{i:03d} common {'yes' if i % 2 else 'no'}", i % 2, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "post_id string, text string, label int, weight double")
    m = models.fit(models.rf_pipeline(n_trees=2, max_depth=2), df, max_rows=30)
    assert len(m.stages[1].vocabulary) == 123 and m.stages[2].numDocs == 120
