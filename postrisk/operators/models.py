"""TF-IDF features, tree-ensemble baselines, scoring and a pluggable per-task model hook."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postrisk.constants import N_TREES, SPLIT_SEED, TFIDF_MAX_FEATURES
from postrisk.functions.text import words
from postrisk.session import by_key, materialize

TOKEN_PATTERN = "[a-z0-9]{2,}"
BROADCAST_MAX_TERMS = 2_000_000  # words of two or more characters of cleaned text


def tfidf_table(df: DataFrame, text_col: str = "text", key: str = "post_id",
                max_features: int = TFIDF_MAX_FEATURES, fit: DataFrame | None = None) -> DataFrame:
    """M1 in table form: (key, term, tf, weight) with the vocabulary of the
    ``max_features`` most frequent terms (ties by term) of ``fit`` (default: ``df``),
    smoothed idf ``ln((1+n)/(1+df)) + 1`` and per-document L2 normalisation.

    Texts are dealt by key into tasks of a bounded length (``df`` and ``fit`` are stored tables), so a
    document is counted and normed where it lies and a task's counts don't grow with the table; the
    vocabulary is a bounded top-k and therefore broadcast; the norm is a window per document."""
    dealt = by_key(df.select(key, text_col), key, text_col)
    fit, df = dealt if fit is None else by_key(fit.select(key, text_col), key, text_col), dealt

    def tokens(x):
        return x.select(key, F.explode(words(text_col)).alias("term")).filter(F.length("term") >= 2)

    fit_tf = tokens(fit).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = fit.select(F.count(F.lit(1))).scalar()
    vocab = (fit_tf.groupBy("term").agg(F.sum("tf").alias("_total"), F.count(F.lit(1)).alias("_df"))
             .orderBy(F.desc("_total"), F.asc("term")).limit(int(max_features))
             .select("term", (F.log((n_docs + 1) / (F.col("_df") + 1)) + 1).alias("_idf")))
    # the vocabulary has at most max_features rows: broadcast below a fixed bound; joining it to
    # the tokens first means only vocabulary terms are counted for the weights
    v = F.broadcast(vocab) if max_features <= BROADCAST_MAX_TERMS else vocab
    tf = tokens(df).join(v, "term").groupBy(key, "term", "_idf").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.select(key, "term", "tf", (F.col("_w") / norm).alias("weight"))


def tfidf_stages(max_features: int = TFIDF_MAX_FEATURES, input_col: str = "text") -> list:
    """M1 as Spark ML stages (for model training): tokenise, count the top
    ``max_features`` terms, idf, L2 normalise. Spark's idf has no ``+1`` term, so
    weights differ from the table form by that constant per term."""
    return [RegexTokenizer(inputCol=input_col, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
            CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=max_features),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)]


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``n / (n_classes * n_class)`` per row (the usual balanced class weighting)."""
    every = Window.partitionBy(F.lit(1))
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    c = c.select(label, (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias(out))
    return df.join(c, label, "left")


def positive_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Positives weighted ``n0 / max(n1, 1)``, negatives 1 (boosting's ``scale_pos_weight``)."""
    s = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    ratio = s.select((F.col("n0") / F.greatest(F.col("n1"), F.lit(1))).alias("r")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def rf_pipeline(n_trees: int = N_TREES, max_depth: int = 30, max_features: int = TFIDF_MAX_FEATURES,
                seed: int = SPLIT_SEED) -> Pipeline:
    """M2: TF-IDF + random forest (sqrt features per split, class-balanced weights)."""
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                                numTrees=n_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                seed=seed, probabilityCol="probability")
    return Pipeline(stages=[*tfidf_stages(max_features), rf])


def gbt_pipeline(n_rounds: int = N_TREES, max_depth: int = 6, step: float = 0.3,
                 max_features: int = TFIDF_MAX_FEATURES, seed: int = SPLIT_SEED) -> Pipeline:
    """M3: TF-IDF + gradient boosted trees (logistic loss, positive-class weight)."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=n_rounds,
                        maxDepth=max_depth, stepSize=step, lossType="logistic", seed=seed)
    return Pipeline(stages=[*tfidf_stages(max_features), gbt])


def nb_pipeline(max_features: int = TFIDF_MAX_FEATURES) -> Pipeline:
    """A light multinomial naive Bayes scorer on term counts (used for explanations)."""
    stages = tfidf_stages(max_features)[:2]
    nb = NaiveBayes(labelCol="label", featuresCol="_tf", modelType="multinomial", probabilityCol="probability")
    return Pipeline(stages=[*stages, nb])


FIT_PART_ROWS = 4_000


def fit(pipeline: Pipeline, train: DataFrame, max_rows: int | None = None, key: str = "post_id") -> PipelineModel:
    """Fit every stage on all rows. Feature rows are written once, so trees read them and not the texts. They are dealt
    into parts of at most about ``FIT_PART_ROWS``: the trees hold a row as one number for each feature, however few it has.

    ``max_rows``: a bound on the feature rows that tree ensembles are fitted on (a sample by a hash of the key), for
    trials; by default all are. Trees of unbounded depth grow with the rows they see and end on the driver."""
    *before, last = pipeline.getStages()
    features = Pipeline(stages=before).fit(train)
    rows = features.transform(train).select(key, "label", *[c for c in ("weight",) if c in train.columns], last.getFeaturesCol())
    if not isinstance(last, (RandomForestClassifier, GBTClassifier)):
        return PipelineModel(stages=[*features.stages, last.fit(rows)])
    rows = materialize(rows, "features")
    n = rows.count()
    if max_rows is not None and n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
        n = max_rows
    rows = rows.repartition(max(1, -(-n // FIT_PART_ROWS)), key)
    return PipelineModel(stages=[*features.stages, last.fit(rows)])


def score(df: DataFrame, model: PipelineModel, out: str = "P_hoax") -> DataFrame:
    """M5: class-1 probability of a fitted pipeline as ``P_hoax`` (original columns kept)."""
    cols = df.columns
    scored = model.transform(df)
    return scored.select(*cols, vector_to_array("probability")[1].alias(out))


def score_with(df: DataFrame, load_fn: Callable[[], object],
               predict_fn: Callable[[object, pd.Series], "pd.Series"], text_col: str = "text",
               out: str = "P_hoax") -> DataFrame:
    """M6: any user model, loaded once per task and called once per Arrow batch
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows) with the texts."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches):
        model = load_fn()
        for pdf in batches:
            pdf[out] = pd.Series(predict_fn(model, pdf[text_col]), index=pdf.index).astype("float64")
            yield pdf

    return df.mapInPandas(run, schema)
