"""Tree passes in tasks of bounded size, and pieces of frequent and other words."""

import random
from collections import Counter

from pyspark.sql import functions as F

from postrisk.operators import boosting, cells, forest, subwords
from tests.test_boosting import _data, _tables


def _rows(spark):
    c, labels, weight = _data()
    w, rows = _tables(spark, c, labels, weight)
    return boosting.binned_rows(w, rows, boosting.term_cuts(w, rows, bins=5)).persist()


def test_trees_read_rows_dealt_by_their_entries(spark, monkeypatch):
    rows = _rows(spark)
    whole = boosting.fit(rows, rounds=2, depth=2), sorted(forest.fit(rows, 2, n_trees=3, depth=2).nodes.collect())
    n = rows.agg(F.sum(F.size("cells") + 8)).first()[0]
    monkeypatch.setattr(cells, "TASK_CELLS", 100)
    stored = cells.dealt(cells.unpack(rows.coalesce(1)), "t").withColumn("file", F.input_file_name())
    files = [r.n for r in stored.groupBy("file").agg(F.sum(F.size("_terms") + 8).alias("n")).collect()]
    assert len(files) == -(-n // 100) and max(files) < 300
    assert (boosting.fit(rows, rounds=2, depth=2), sorted(forest.fit(rows, 2, n_trees=3, depth=2).nodes.collect())) == whole


def test_sums_are_the_same_dense_and_sorted(monkeypatch):
    import numpy as np
    r = random.Random(2)
    for dense in (0, cells.DENSE):
        monkeypatch.setattr(cells, "DENSE", dense)
        monkeypatch.setattr(cells, "SUMS", 20)
        want, sums = Counter(), cells.Sums(1)
        for _ in range(6):
            terms = r.sample(["a", "b", "c", "d"], 3)
            lines = [(r.choice((1, 2, 5 << 40)), r.randrange(-1, 3), r.randrange(4), r.randrange(-9, 1 << 40)) for _ in range(50)]
            for g, c, b, v in lines:
                want[g, terms[c] if c >= 0 else None, b] += v
            g, c, b, v = (np.array(x) for x in zip(*lines))
            sums.add(g, terms, c, b, [v])
        got = [x for g, t, b, (v,) in sums.take() for x in zip(g.tolist(), t.to_pylist(), b.tolist(), v.tolist())]
        assert len(got) == len(want) and {x[:3]: x[3] for x in got} == want


def test_words_meet_their_pieces_broadcast_and_joined(spark, monkeypatch):
    posts = spark.createDataFrame([(k, " ".join(["hot"] * 20 + [f"w{j}" for j in range(k)])) for k in range(8)] + [(9, "")], "post_id long, text string")
    vocab = subwords.count_pieces(posts, size=30)
    want = sorted(subwords.subword_pieces(posts, vocab).collect())
    assert len({x.pos for x in want if x.post_id == 7}) == 27
    for head in (2, 3, 1):
        monkeypatch.setattr(subwords, "HEAD_WORDS", head)
        assert sorted(subwords.subword_pieces(posts, vocab).collect()) == want


def test_first_gains_where_no_label_of_a_line_is_known(spark):
    cells_of = [("a", 1, {"x": 1, "y": 2}), ("b", 0, {"x": 2}), ("c", None, {"x": 3, "z": 1}), ("d", 1, {"y": 1}), ("e", 0, {"y": 2, "x": 1})]
    rows = spark.createDataFrame([(k, y, 8.0, c) for k, y, c in cells_of], "post_id string, label int, weight double, cells map<string,int>")
    got = {r.term: r.gain for r in boosting.root_gains(rows).collect()}
    assert got["z"] is None and got["x"] is None and got["y"] is not None


def test_raw_posts_deal_the_texts_out_once(spark, tmp_path):
    """F16: what is grouped by post id moves the joined texts no second time."""
    from datetime import datetime

    from postrisk.operators.cleaning import clean_posts
    from postrisk.sources import fixtures
    spark.createDataFrame([(i, f"text {i}", "en", "web") for i in (1, 2, 6, 6, None)], "doc_id long, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, datetime(2024, 1, 3), kind) for k, kind in ((1, "view"), (6, "click"), (11, "view"), (2, "purchase"), (None, "view"))],
                          "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = fixtures.raw_posts(spark, str(tmp_path))
        got = sorted((x.post_id, x.source_rank, x.likes, x.reposts, x.replies) for x in raw.collect())
        plan = clean_posts(raw)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # 5 documents: events meet documents modulo 5, so 1, 6 and 11 are views and clicks of document 1
    assert got == [("1", 0, "2", "1", "0"), ("1", 1, "3", "1", "0"), ("2", 1, "1", "0", "1")] + \
        [("6", 0, "0", "0", "0")] * 2 + [("6", 1, "1", "0", "0")] * 2
    above = plan[:plan.index("SortMergeJoin")]
    assert "SortAggregate" in above and "Exchange" not in above, plan
