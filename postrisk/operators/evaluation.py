"""Threshold sweep, classification metrics, average precision, threshold choice, model comparison.

Every metric comes from confusion counts computed in one aggregate (or one
per model); only those few numbers ever leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postrisk.constants import THRESHOLD_CANDIDATES, THRESHOLD_KEEP_SHARE
from postrisk.functions.scores import apply_threshold
from postrisk.operators.ranking import with_running_sums


def _div(a: Column, b: Column) -> Column:
    """``a / b`` with 0 for a zero denominator (``zero_division=0``)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics_from_counts(tp, fp, fn, tn) -> dict[str, Column]:
    """Accuracy, class-1 precision/recall and macro F1 over the labels present."""
    tp, fp, fn, tn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn, tn))
    f1_pos = _div(2 * tp, 2 * tp + fp + fn)
    f1_neg = _div(2 * tn, 2 * tn + fn + fp)
    has_pos = (tp + fn + fp) > 0
    has_neg = (tn + fp + fn) > 0
    n_lab = has_pos.cast("int") + has_neg.cast("int")
    macro = _div(F.when(has_pos, f1_pos).otherwise(0.0) + F.when(has_neg, f1_neg).otherwise(0.0), n_lab)
    return {
        "accuracy": _div(tp + tn, tp + fp + fn + tn),
        "precision_hoax": _div(tp, tp + fp),
        "recall_hoax": _div(tp, tp + fn),
        "macro_f1": macro,
    }


def _counts(pred: Column, y: Column, suffix: str = "") -> list[Column]:
    return [F.count_if((pred == 1) & (y == 1)).alias(f"tp{suffix}"),
            F.count_if((pred == 1) & (y == 0)).alias(f"fp{suffix}"),
            F.count_if((pred == 0) & (y == 1)).alias(f"fn{suffix}"),
            F.count_if((pred == 0) & (y == 0)).alias(f"tn{suffix}")]


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLD_CANDIDATES,
                    p: str = "P_hoax", y: str = "label", digits: int = 4) -> DataFrame:
    """One pass computing the confusion counts of every candidate threshold,
    then one row per threshold with recall, precision and macro F1 (rounded)."""
    ts = [round(float(t), 2) for t in thresholds]
    aggs = []
    for i, t in enumerate(ts):
        aggs += _counts(apply_threshold(p, t), F.col(y), f"_{i}")
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{i}").alias("tp"),
                              F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn"),
                              F.col(f"tn_{i}").alias("tn")) for i, t in enumerate(ts)])
    long = wide.select(F.inline(rows))
    m = metrics_from_counts("tp", "fp", "fn", "tn")
    return long.select("threshold",
                       F.bround(m["recall_hoax"], digits).alias("recall_hoax"),
                       F.bround(m["precision_hoax"], digits).alias("precision_hoax"),
                       F.bround(m["macro_f1"], digits).alias("macro_f1"),
                       "tp", "fp", "fn", "tn")


def choose_threshold(sweep: DataFrame, keep: float = THRESHOLD_KEEP_SHARE) -> DataFrame:
    """Among thresholds whose macro F1 is at least ``keep`` x the best, the one
    with the highest recall (lowest threshold on ties)."""
    best = sweep.select(F.max("macro_f1")).scalar()
    eligible = sweep.filter(F.col("macro_f1") >= best * keep)
    return (eligible.orderBy(F.desc("recall_hoax"), F.asc("threshold")).limit(1)
            .select(F.col("threshold").alias("chosen_threshold"), "recall_hoax", "precision_hoax", "macro_f1"))


def classification_report(df: DataFrame, threshold: float | Column = 0.5, p: str = "P_hoax",
                          y: str = "label", pred: str | None = None, digits: int = 4) -> DataFrame:
    """E2 (+E5): 1-row report with accuracy, class-1 precision/recall, macro F1 and
    the confusion matrix ``[[TN, FP], [FN, TP]]``. ``pred`` uses a ready prediction
    column instead of thresholding ``p``."""
    pc = F.col(pred) if pred else apply_threshold(p, threshold)
    c = df.agg(*_counts(pc, F.col(y)))
    m = metrics_from_counts("tp", "fp", "fn", "tn")
    return c.select(*[F.bround(v, digits).alias(k) for k, v in m.items()],
                    F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
                    "tn", "fp", "fn", "tp")


def average_precision(df: DataFrame, p: str = "P_hoax", y: str = "label",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision ``sum_n (R_n - R_{n-1}) P_n`` over distinct
    scores, highest first (the usual "AP", not the trapezoid PR area).

    Scores are grouped (partial aggregate), cumulative counts come from the
    bucketed running sum, so no single task sees all scores."""
    group_cols = list(group_cols)
    per = df.groupBy(*group_cols, p).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                         F.count_if(F.col(y) == 0).alias("neg"))
    cum = with_running_sums(per, group_cols, p, ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = cum.groupBy(*group_cols).agg(F.sum(F.col("pos") * prec).alias("_s"),
                                       F.sum("pos").alias("_P"))
    return agg.select(*group_cols, F.when(F.col("_P") > 0, F.col("_s") / F.col("_P")).alias("pr_auc"))


def model_comparison(scores: DataFrame, thresholds: DataFrame | None = None, model: str = "model",
                     p: str = "P_hoax", y: str = "label", digits: int = 4) -> DataFrame:
    """One row per model (accuracy, precision, recall, macro F1, PR-AUC).

    ``scores`` is long: (model, p, label[, threshold]); each model may carry its
    own threshold (a tuned one, or 0.5 for argmax baselines)."""
    s = scores if thresholds is None else scores.join(thresholds, model, "left")
    thr = F.coalesce(F.col("threshold"), F.lit(0.5)) if "threshold" in s.columns else F.lit(0.5)
    s = s.withColumn("_pred", apply_threshold(p, thr))
    c = s.groupBy(model).agg(*_counts(F.col("_pred"), F.col(y)))
    m = metrics_from_counts("tp", "fp", "fn", "tn")
    ap = average_precision(scores, p, y, [model])
    return c.join(ap, model, "left").select(
        model, *[F.bround(v, digits).alias(k) for k, v in m.items()],
        F.bround("pr_auc", digits).alias("pr_auc"))
