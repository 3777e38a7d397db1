"""Explanations and features without growth per word, whole prompts, feature rows in bounded parts."""

import pytest
from pyspark.sql import functions as F

from postrisk import session
from postrisk.operators import annotation, explain, models
from postrisk.plans import queries
from postrisk.session import by_key


@pytest.fixture(scope="module")
def linear(spark):
    posts = spark.createDataFrame([("1", "a b c a"), ("2", ""), ("3", "zz"), ("4", "b " * 400 + "c"), ("4", "a"), (None, "a b")], "post_id string, text string")
    odds = spark.createDataFrame([("a", 0.5), ("b", -0.25), ("c", 1.0)], "term string, log_odds double")
    return posts, odds, spark.createDataFrame([(0.3,)], "bias double")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_owen_counts_words_once_a_post(linear):
    """nothing is split above a generator, where it would be split again for every word; no coalition is a row."""
    plan = _plan(explain.linear_owen(*linear))
    for line in plan.splitlines():
        assert not ("Project" in line and "split(" in line and "word" in line), line
    assert plan.count("Generate") == 2 and "coalition" not in plan


def test_linear_scores_read_texts_once(linear):
    """one pass over the words, no exchange of texts; rows that share a key or have none keep their score."""
    posts, odds, bias = linear
    out = explain.linear_scores(posts, odds, bias)
    assert _plan(out).count("Generate explode") + _plan(out).count("Generate posexplode") == 2  # words, and a score for each row
    got = sorted((x.post_id or "", round(x.P_hoax, 6)) for x in out.collect())
    s = lambda z: round(1 / (1 + 2.718281828459045 ** -z), 6)
    four = s(0.3 - 100 + 1 + 0.5)
    assert got == [("", s(0.3)), ("1", s(0.3 + 1.75)), ("2", s(0.3)), ("3", s(0.3)), ("4", four), ("4", four)]
    two = posts.select("post_id", F.lit(1).alias("coalition"), "text").where("post_id = '1'")
    assert explain.linear_scores(two, odds, bias, key=("post_id", "coalition")).columns == ["post_id", "coalition", "P_hoax"]


def test_words_are_grouped_where_their_text_lies(spark, linear, monkeypatch):
    """texts are dealt by key into parts of a bounded length, and no word is exchanged by key."""
    posts, odds, bias = linear
    assert by_key(posts, "post_id", "text", task_chars=100).rdd.getNumPartitions() == 9
    assert by_key(posts.where("false"), "post_id", "text").rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "TASK_CHARS", 100)
    top = explain.top_words(explain.clean_tokens(explain.linear_occlusion(posts, odds, bias)))
    weights = models.tfidf_table(posts, max_features=10)
    for df in (top, weights):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(post_id" in plan
        for line in plan.splitlines():
            assert not ("hashpartitioning(post_id" in line and ("term#" in line or "word#" in line)), line


def test_sheets_are_labelled_by_the_whole_prompt(spark, tmp_path):
    """the registered query sends the guideline too."""
    seen = {}

    def spy(sheets, label_fn, **given):
        seen.update(given)
        return real(sheets, label_fn, **given)
    real, queries.annotation.annotate = annotation.annotate, spy
    docs = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        out = queries.QUERIES["annotate_resume"](spark, str(tmp_path))
    finally:
        queries.annotation.annotate = real
    assert len(seen.get("guideline", "")) % 2 and "label is 1" in seen["guideline"]
    assert str(len(queries.STUB_PREFIX) + len(seen["guideline"])) in queries.ORACLE["annotate_resume"]
    # annotator_2's sheet lacks every 19th label
    n = len(queries.STUB_PREFIX) + len(seen["guideline"])
    assert {(r.post_id, r.label) for r in out.where("auto_reason like 'stub%' and post_id in ('19', '38')").collect()} == {("19", (n + 19) % 2), ("38", (n + 38) % 2)}


def test_trees_read_bounded_parts(spark, monkeypatch):
    """Feature rows of one file are dealt into parts of a bounded number of rows."""
    parts = []
    last = models.rf_pipeline(n_trees=1, max_depth=1).getStages()[-1].__class__
    real = last.fit
    monkeypatch.setattr(last, "fit", lambda self, df, *a: (parts.append(df.rdd.getNumPartitions()), real(self, df, *a))[1])
    monkeypatch.setattr(models, "FIT_PART_ROWS", 10)
    df = spark.createDataFrame([(str(i), f"w{i % 7} common", i % 2, 1.0) for i in range(60)], "post_id string, text string, label int, weight double").coalesce(1)
    models.fit(models.rf_pipeline(n_trees=1, max_depth=1), df)
    assert parts == [6]


def test_stream_ingest_state_holds_keys_alone_and_is_asked_once(spark, tmp_path):
    """The state is Spark's own de-duplication of keys, no Python call a key; a batch's writes share one run of it."""
    from postrisk.streaming.ingest import late_path, seed_sink, stream_ingest
    cols = "post_id string, collection_type string, query string, text string, scraped_at_utc string, source_rank int, row_ord long"

    def rows(*r):
        return spark.createDataFrame([(i, "c", "q", t, s, 0, n) for n, (i, t, s) in enumerate(r)], cols).coalesce(1)
    early, late = "2024-02-01T01:00:00Z", "2024-02-01T12:00:00Z"
    seed_sink(rows(("0", "old", late), ("0", "older", late)), f"{tmp_path}/sink")
    rows((None, "n1", early), (None, "n2", late), ("0", "again", early), ("2", "a", early), ("2", "b", early), ("1", "x", late)).write.parquet(f"{tmp_path}/in")
    q = stream_ingest(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/sink", f"{tmp_path}/ck",
                      watermark=("scraped_at_utc", "1 hour"))
    q.awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/sink").where("_batch >= 0").collect()
    assert sorted(r.text for r in stored) == ["a", "n1", "x"]
    assert sorted(r.text for r in spark.read.parquet(late_path(f"{tmp_path}/sink")).collect()) == ["a", "b", "n1"]
    state = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert {o["operatorName"] for o in state} == {"dedupe"} and state[-1]["numRowsTotal"] == 3 and sum(o["numRowsUpdated"] for o in state) == 3
