"""Global min-max scaling (fit once, apply anywhere) and the engagement feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.constants import CLEAN_COLUMNS
from postrisk.operators.cleaning import clean_posts, kept_rows, row_features, select_output
from postrisk.session import materialize as _materialize

NORM_COLUMNS = {"amplification_raw": "amplification_norm", "velocity_raw": "velocity_norm"}


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    """T12 fit: a 1-row table ``{c}_min, {c}_max`` from one partial aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    return df.agg(*aggs)


def apply_minmax(df: DataFrame, params, cols: Mapping[str, str]) -> DataFrame:
    """T12 apply: ``(x-min)/(max-min)``, 0 when the range is empty.

    ``params`` is the fitted 1-row DataFrame - planned as one scalar subquery
    (bound once to a struct column, so it runs once; no join) - or a dict of
    frozen numbers (streams score with fixed parameters)."""
    if isinstance(params, DataFrame):
        out = df.withColumn("_mm", params.select(F.struct(*params.columns)).scalar())
        bound = {f"{c}_{k}": F.col(f"_mm.{c}_{k}") for c in cols for k in ("min", "max")}
    else:
        out = df
        bound = {f"{c}_{k}": F.lit(float(params[f"{c}_{k}"])) for c in cols for k in ("min", "max")}
    new = {}
    for src, dst in cols.items():
        lo, hi = bound[f"{src}_min"], bound[f"{src}_max"]
        x = F.col(src)
        new[dst] = F.when(hi == lo, x * 0.0).otherwise((x - lo) / (hi - lo))
    out = out.withColumns(new)
    return out.drop("_mm") if "_mm" in out.columns else out


def engagement_features(raw: DataFrame, params=None, materialize: bool = False,
                        strip_keycaps: bool = True) -> DataFrame:
    """T1-T12 end to end: the 13-column cleaned post table.

    The scaling needs statistics of the whole cleaned table, i.e. two passes;
    ``materialize=True`` checkpoints the unscaled table into the shared folder so
    the text cleaning runs once (worth it on large inputs), otherwise Spark
    recomputes the upstream for the statistics."""
    pre = row_features(raw, strip_keycaps)
    base = clean_posts(raw, strip_keycaps, pre=pre)
    if materialize:
        base = _materialize(base)
    if params is None:
        # statistics from a narrow de-dup of the numeric columns: the text is
        # neither shuffled nor cleaned a second time for them
        stats_src = base if materialize else kept_rows(raw, list(NORM_COLUMNS), strip_keycaps, pre=pre)
        params = fit_minmax(stats_src, list(NORM_COLUMNS))
    return select_output(apply_minmax(base, params, NORM_COLUMNS), CLEAN_COLUMNS)
