"""Risk score, zone, contributions and the review-queue views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.constants import ALL_ZONES, ZONE_GREEN, ZONE_RED, ZONE_YELLOW
from postrisk.functions.scores import _weights, response, risk_score, round2, zone

QUEUE_COLUMNS = ("text", "P_hoax", "amplification_norm", "velocity_norm", "Risk_Score",
                 "Zona_Triase", "Target_Respons")


def triage(df: DataFrame, weights=None, p_col: str = "P_hoax", amp_col: str = "amplification_norm",
           vel_col: str = "velocity_norm") -> DataFrame:
    """Row-local columns only, so it works unchanged on a stream."""
    wh, wa, wv = _weights(weights)
    score = risk_score(p_col, amp_col, vel_col, (wh, wa, wv))
    return df.withColumns({
        "Risk_Score": score,
        "Kontribusi_Teks": F.col(p_col) * wh * 100,
        "Kontribusi_Amplifikasi": F.col(amp_col) * wa * 100,
        "Kontribusi_Velositas": F.col(vel_col) * wv * 100,
    }).withColumns({"Zona_Triase": zone("Risk_Score"), "Target_Respons": response("Risk_Score")})


def triage_queue(df: DataFrame, k: int | None = None, columns: Sequence[str] | None = None,
                 key: str = "post_id") -> DataFrame:
    """Q1/Q4: highest risk first (ties by key). With ``k`` Spark plans a
    ``TakeOrderedAndProject`` (per-partition top-k, then merge) instead of a sort."""
    out = df.orderBy(F.desc("Risk_Score"), F.asc(key))
    if k is not None:
        out = out.limit(int(k))
    if columns is not None:
        out = out.select(*columns)
    return out


def zone_kpis(df: DataFrame) -> DataFrame:
    """Q2: total and count per zone in one aggregate (zeros for empty zones)."""
    z = F.col("Zona_Triase")
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(z == ZONE_RED).alias("n_merah"),
                  F.count_if(z == ZONE_YELLOW).alias("n_kuning"),
                  F.count_if(z == ZONE_GREEN).alias("n_hijau"))


def filter_zone(df: DataFrame, zone_name: str) -> DataFrame:
    """Q3: ``Semua Zona`` keeps everything, otherwise equality on the zone."""
    if zone_name == ALL_ZONES:
        return df
    return df.filter(F.col("Zona_Triase") == zone_name)


def lookup_text(df: DataFrame, text: str, key: str = "post_id") -> DataFrame:
    """Q5: the first row (queue order) having exactly this text."""
    return df.filter(F.col("text") == text).orderBy(F.desc("Risk_Score"), F.asc(key)).limit(1)


def lookup_texts(df: DataFrame, texts: DataFrame, key: str = "post_id") -> DataFrame:
    """Q5 for many texts at once: per text the row first in queue order.

    Texts are found by two 64-bit hashes: the winner of each hash pair is chosen on
    (score, key) alone, combined map-side, and the texts themselves move once, in
    the join that fetches the winners. Keys are taken to be unique."""
    h = [F.xxhash64("text").alias("_h1"), F.xxhash64("text", F.lit(1)).alias("_h2")]
    order = F.struct(F.coalesce(-F.col("Risk_Score"), F.lit(float("inf"))).alias("s"), F.col(key).alias("k"))
    asked = texts.select(*h).distinct()
    best = (df.select(*h, order.alias("o")).join(asked, ["_h1", "_h2"], "left_semi")
            .groupBy("_h1", "_h2").agg(F.min("o")["k"].alias("_best")))
    return df.join(best.select("_best"), F.col(key) == F.col("_best"), "left_semi")


def detail_view(df: DataFrame) -> DataFrame:
    """Q6: display strings (probability as a percentage, norms with 2 decimals)."""
    return df.select(
        "post_id", "text",
        F.format_string("%.2f%%", round2(F.col("P_hoax") * 100)).alias("prob_text"),
        F.format_string("%.2f", round2("amplification_norm")).alias("amp_text"),
        F.format_string("%.2f", round2("velocity_norm")).alias("vel_text"))
