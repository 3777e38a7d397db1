"""Column functions on hand-made rows (text cleaning, counters, time, risk)."""

import math

import pytest

from postrisk.functions import text as TX
from pyspark.sql import functions as F

from postrisk.functions.scores import coerce_count, hours_between, parse_ts, response, risk_score, round2, zone

# text and what the cleaning rules make of it, by hand
HAND = [
    ("Cek http://a.b/c ya @jos\u00e9_1 #Bansos a#b caf\u00e9 1\ufe0f\u20e3 ok \U0001f600 WWW.x www.y.z/\u00e9 x", "cek ya bansos ab caf ok www x x"),
    ("#", ""), ("@\u00e9", ""), ("", ""), ("   ", ""), ("a\u00a0b", "a b"), ("http://x.y\u00a0z", "z"),
    ("@abchttp://x", ""), ("@wwwx.www.y", ""), ("@ab www.c d", "d"), ("1@ab\ufe0f\u20e3", "1"), ("#\ufe0f\u20e3x", "x"),
    ("x\u2028y\x1cz", "x y z"), ("Tab\tNew\nLine\rEnd", "tab new line end"), ("A!#B", "a b"), ("a#!b", "a b"),
    ("\u00c9COLE 42", "cole 42"), ("mail me@x.org or @user_name!", "mail me org or"),
    ("https://t.co/abc?x=1#frag end", "end"), ("\u0661\u0662 arabic digits", "arabic digits"),
    # a bare prefix is no URL, so a mention runs through it
    ("see @https:// now", "see now"), ("@www.", ""), ("@www.x", ""), ("a@http://", "a"), ("x @a_1.b", "x b"),
]


def _clean_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.c for r in df.select("i", TX.clean_text("t").alias("c")).collect()}


def test_clean_text_by_hand(spark):
    got = _clean_rows(spark, [t for t, _ in HAND] + [None])
    for i, (t, want) in enumerate(HAND):
        assert got[i] == want, t
    assert got[len(HAND)] == ""


def test_clean_text_leaves_plain_words(spark):
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("text", TX.clean_text("text").alias("c"))
    for r in docs.collect():
        assert not set(r.c) - set("abcdefghijklmnopqrstuvwxyz0123456789 ")
        assert r.c == r.c.strip() and "  " not in r.c


def test_cleans_to_empty_agrees(spark):
    texts = [t for t, _ in HAND] + ["!!!", "@only", "http://only.url", "1️⃣", "# # #", "é ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", TX.cleans_to_empty("t").alias("e"), TX.clean_text("t").alias("c")).collect()
    for r in rows:
        assert r.e == (r.c == ""), r.t


def test_has_content_python_whitespace(spark):
    df = spark.createDataFrame([("  ",), ("  x ",), ("\x1c",), (None,)], "t string")
    got = [r.h for r in df.select(TX.has_content("t").alias("h")).collect()]
    assert got == [False, True, False, False]


def test_coerce_count(spark):
    vals = ["abc", "-5", "NaN", "12d", " 7 ", "3.5", None, "1e2", "\t5", "\n8\r"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.c for r in df.select(coerce_count("v").alias("c")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 7.0, 3.5, 0.0, 100.0, 5.0, 8.0]


def test_hours(spark):
    rows = [("2024-01-02T00:00:00+00:00", "2024-01-01T00:00:00+00:00"),  # scraped before posted
            ("garbage", "2024-01-01T00:00:00+00:00"),
            ("Wed Oct 10 20:19:24 +0000 2018", "2018-10-10T22:19:24+00:00")]
    df = spark.createDataFrame(rows, "p string, s string")
    got = [r.h for r in df.select(hours_between(parse_ts("p"), parse_ts("s")).alias("h")).collect()]
    assert got[0] == 0.0 and got[1] is None and got[2] == pytest.approx(2.0)


def test_times_without_offset_are_utc(spark):
    zone_before = spark.conf.get("spark.sql.session.timeZone")
    rows = [("2024-03-10T02:30:00", 1710037800), ("2024-01-01 05:00:00", 1704085200), ("2024-01-01", 1704067200),
            ("2024-01-01T00:00:00+02:00", 1704060000), ("2024-01-01T00:00:00Z", 1704067200), ("x", None)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
        got = [r.t for r in df.select(F.unix_seconds(parse_ts("s")).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone_before)
    assert got == [w for _, w in rows]


def test_round2_is_pythons_round(spark):
    import random
    r = random.Random(1)
    xs = [2.675, 1.005, 0.125, 0.145, 1.115, -1.115, 1e15, 0.0] + [r.randrange(10 ** 6) / 1000 for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round2("x").alias("y")).collect()
    assert [(g.x, g.y) for g in got if g.y != round(g.x, 2)] == []


def test_risk_zone(spark):
    rows = [(0.8, 0.5, 0.4), (1.0, 0.8, 0.4), (0.5, 0.3, 0.3), (float("nan"), 0.1, 0.1)]
    df = spark.createDataFrame(rows, "p double, a double, v double")
    out = df.select(risk_score("p", "a", "v").alias("s")).select("s", zone("s").alias("z"),
                                                                 response("s").alias("r")).collect()
    assert out[0].s == 62.5 and out[0].z == "Kuning"
    assert out[1].s == 80.0 and out[1].z == "Merah" and out[1].r == "Immediate (< 1 jam)"
    assert out[2].s == 40.0 and out[2].z == "Kuning"
    assert math.isnan(out[3].s) and out[3].z == "Hijau"
    edge = spark.createDataFrame([(70.0,), (39.99,)], "s double").select(zone("s").alias("z")).collect()
    assert [r.z for r in edge] == ["Merah", "Hijau"]
    with pytest.raises(ValueError):
        risk_score("p", "a", "v", (0.5, 0.5, 0.5))


def test_token_cleanup(spark):
    df = spark.createDataFrame([("[CLS]",), ("##kan",), ("!!",), (" Rakyat",), ("</s>",)], "w string")
    got = [r.c for r in df.select(TX.clean_token("w").alias("c")).collect()]
    assert got == [None, "kan", None, "rakyat", None]
