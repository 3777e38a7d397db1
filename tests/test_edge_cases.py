"""Inputs the fixtures don't have: tables without arrival numbers, long posts, lone raters, late rows."""

import pytest
from pyspark.sql import functions as F

from postrisk.operators import annotation, cleaning, explain, features, ingest
from postrisk.session import checkpoint_dir
from postrisk.streaming.ingest import late_path, seed_sink, stream_ingest


def _posts(spark, rows):
    cols = "post_id string, query string, text string, likes string, reposts string, replies string, timestamp_utc string, " \
           "author_username string, scraped_at_utc string"
    return spark.createDataFrame([(i, q, t, n, "0", "0", "2024-01-01T00:00:00Z", "a", s) for i, q, t, n, s in rows], cols)


def test_keep_first_without_source_rank(spark):
    day = ["2024-02-01T00:00:00Z", "2024-02-02T00:00:00Z"]
    df = _posts(spark, [("1", "q", "late", "1", day[1]), ("1", "q", "early", "2", day[0]), ("2", "q", "same", "3", day[0]),
                        ("2", "q", "same", "3", day[0]), (None, "q", "x", "1", day[0]), (None, "q", "y", "1", day[0])])
    got = sorted((r.post_id or "", r.text) for r in features.engagement_features(df).collect())
    assert got == [("", "x"), ("1", "early"), ("2", "same")]
    audit = {r.step: r.rows for r in cleaning.cleaning_audit(df).collect()}
    assert audit["input"] == 6 and audit["duplicate_id"] == 3 and audit["output"] == 3


def test_occlusion_reaches_every_word(spark):
    text = " ".join(["pad"] * 200 + ["trigger"])
    df = spark.createDataFrame([("1", text)], "post_id string, text string")
    out = explain.occlusion(df, lambda d: d.withColumn("P_hoax", F.col("text").contains("trigger").cast("double"))).collect()
    assert len(out) == 201
    assert [(r.pos, r.weight) for r in out if r.weight] == [(200, 1.0)]


def test_linear_occlusion_equals_leave_one_out(spark):
    train = spark.createDataFrame([("a", "x y z", 1), ("b", "x x w", 1), ("c", "y w w", 0), ("d", "", 0)], "post_id string, text string, label int")
    odds, bias = explain.fit_naive_bayes(train)
    df = spark.createDataFrame([("1", "x y w unseen x"), ("2", "w"), ("3", "")], "post_id string, text string")

    def scorer(d):
        d = d.withColumn("row", F.monotonically_increasing_id().cast("string"))
        return d.join(explain.linear_scores(d, odds, bias, key="row"), "row").drop("row")
    d = df.persist()
    slow = {(r.post_id, r.pos): r.weight for r in explain.occlusion(d, scorer).collect()}
    fast = {(r.post_id, r.pos): r.weight for r in explain.linear_occlusion(d, odds, bias).collect()}
    assert slow.keys() == fast.keys() and len(fast) == 6
    for k in fast:
        assert fast[k] == pytest.approx(slow[k], abs=1e-12)


def test_agreement_with_lone_raters_and_gaps(spark):
    rows = [("1", "a", 1), ("1", "b", 1), ("1", "c", 0), ("2", "a", 0), ("2", "b", 0), ("2", "c", 0), ("3", "a", 1), ("4", "a", None)]
    df = spark.createDataFrame(rows, "post_id string, annotator string, label int")
    votes = {r.post_id: r.label for r in annotation.majority_vote(df).collect()}
    assert votes == {"1": 1, "2": 0, "3": 1, "4": None}
    k = annotation.fleiss_kappa(df).first()
    assert k.n_items == 2 and k.n_raters_min == 3 and k.kappa == pytest.approx((2 / 3 - 5 / 9) / (1 - 5 / 9))
    assert annotation.agreement_gate(df).first().pct_ambiguous == 50.0
    alone = annotation.agreement_gate(df.filter("post_id > '2'")).first()
    assert alone.kappa is None and alone.pct_ambiguous is None


def test_labels_given_as_numbers(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (2.0,), (None,)], "label double")
    assert [r[0] for r in df.select(annotation.existing_label("label")).collect()] == [1, 0, None, None]


def test_broken_replies(spark):
    df = spark.createDataFrame([("{bad}",), ("none",), ('{"label": 5}',), ('x {"label": "1", "reason": " y "} z',), (None,)], "r string")
    got = [tuple(r.p) for r in df.select(annotation.parse_label_response("r").alias("p")).collect()]
    assert got[:4] == [(None, None, "invalid json"), (None, None, "no json object"), (None, None, "invalid label"), (1, "y", None)]


def test_topics_meet_posts_on_their_rarest_word(spark):
    posts = spark.createDataFrame([(str(i), "common words here") for i in range(50)] + [("x", "common rare words"), ("y", "")],
                                  "post_id string, text string")
    topics = ingest.topic_table(spark, [("t1", "common rare"), ("t2", "words common"), ("t3", "common absent"), ("t4", "!!")])
    anchors = {r.topic: r._anchor for r in ingest.anchored_topics(posts, topics).collect()}
    assert anchors == {"t1": "rare", "t2": "common", "t3": "absent"}
    got = ingest.tag_topics(posts, topics).collect()
    assert {(r.post_id, r.topic) for r in got if r.topic == "t1"} == {("x", "t1")}
    assert sum(r.topic == "t2" for r in got) == 51 and len(got) == 52


def test_late_stream_rows_are_kept_and_listed(spark, tmp_path):
    cols = "post_id string, collection_type string, query string, text string, scraped_at_utc string, source_rank int, row_ord long"

    def rows(*r):
        return spark.createDataFrame([(i, "c", "q", t, s, 0, n) for n, (i, t, s) in enumerate(r)], cols)
    seed_sink(rows(("0", "old", "2024-02-01T12:00:00Z")), f"{tmp_path}/sink")
    rows(("0", "again", "2024-02-01T12:00:00Z"), ("1", "first", "2024-02-01T12:00:00Z"), ("1", "second", "2024-02-01T12:30:00Z"),
         ("2", "late", "2024-02-01T01:00:00Z")).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_ingest(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/sink", f"{tmp_path}/ck",
                      watermark=("scraped_at_utc", "1 hour"))
    q.awaitTermination()
    got = {r.post_id: r.text for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got == {"0": "old", "1": "first", "2": "late"}
    assert [r.text for r in spark.read.parquet(late_path(f"{tmp_path}/sink")).collect()] == ["late"]


def test_no_private_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
