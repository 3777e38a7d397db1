"""Model training and explanation queries (rows-only in the oracle gate)."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from postrisk.operators import explain, models
from tests.conftest import SF_SMALL


def test_rf_finds_the_planted_words(spark):
    rows = entry.queries()["rf_scores"](spark, SF_SMALL).collect()
    assert rows and all(r.predicted == r.label for r in rows)


def test_model_learns_separable_fixture(spark):
    rows = [(str(i), ("alpha beta " if i % 2 else "gamma delta ") * 3, i % 2, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "post_id string, text string, label int, weight double")
    m = models.fit(models.rf_pipeline(n_trees=10, max_depth=5), df)
    s = {r.post_id: r.P_hoax for r in models.score(df, m).collect()}
    assert s["1"] > 0.5 > s["0"]


def test_occlusion_ranks_trigger_word_first(spark):
    train = spark.createDataFrame(
        [(str(i), ("hoax " if i % 2 else "") + "news of the day", i % 2) for i in range(40)],
        "post_id string, text string, label int")
    m = models.fit(models.nb_pipeline(), train)
    post = spark.createDataFrame([("x", "news hoax of the day")], "post_id string, text string")
    occ = explain.occlusion(post, lambda d: models.score(d, m))
    top = explain.top_words(occ).orderBy("rank").first()
    assert top.word == "hoax"


def test_plugin_model_loaded_once_per_task(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        calls.add(1)
        return 2.0

    df = spark.range(100).select(F.col("id").cast("string").alias("text")).repartition(3)
    out = models.score_with(df, load, lambda m, t: t.astype(float) * 0 + 1 / m)
    assert out.filter(F.col("P_hoax") == 0.5).count() == 100
    assert calls.value <= 3


def test_model_save_load_and_csv_report(spark):
    import tempfile
    from postrisk.sources import io as pio
    from postrisk.operators import evaluation
    d = tempfile.mkdtemp(prefix="postrisk-model-")
    rows = [(str(i), ("alpha " if i % 2 else "gamma ") * 2, i % 2, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "post_id string, text string, label int, weight double")
    m = models.fit(models.rf_pipeline(n_trees=5, max_depth=3), df)
    pio.save_model(m, f"{d}/rf")
    m2 = pio.load_model(f"{d}/rf")
    a = {r.post_id: r.P_hoax for r in models.score(df, m).collect()}
    b = {r.post_id: r.P_hoax for r in models.score(df, m2).collect()}
    assert a == b
    rep = evaluation.classification_report(models.score(df, m2), threshold=0.5).drop("confusion_matrix")
    pio.write_report(rep, f"{d}/cmp", fmt="csv")
    back = spark.read.option("header", True).csv(f"{d}/cmp")
    assert back.count() == 1 and "macro_f1" in back.columns


def test_positive_class_column(spark):
    df = spark.createDataFrame([([0.2, 0.8],)], "v array<double>")
    assert df.select(explain.positive_class("v").alias("p")).first().p == 0.8
