"""Text cleaning as chained regular-expression column functions.

The character classes are written so that Java regex (Spark) and RE2 (the SQL
oracle) behave like Python's Unicode ``re`` on the same input: Python's ``\\S``
is spelled out as "not a Unicode separator and not a control whitespace", and
``\\w`` as letters, numbers and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postrisk.constants import SPECIAL_TOKENS

# --- Fixed values: patterns of the cleaning rules, in their order of use ---
NOT_SPACE = r"[^\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"
URL_PATTERN = r"https?://" + NOT_SPACE + r"+|www\." + NOT_SPACE + r"+"
MENTION_PATTERN = r"@[\p{L}\p{N}_]+"
KEYCAP_PATTERN = r"[0-9#*]\x{FE0F}?\x{20E3}"
SPECIAL_PATTERN = r"[^a-zA-Z0-9\s#]"
SPACE_RUN_PATTERN = r"\s+"
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Spark-side fused form of the URL -> mention -> keycap steps: one left-to-right
# pass is equivalent because a mention may not run into the start of a URL
# (which the sequential form would have removed first). A prefix with nothing after it
# is no URL and doesn't stop the mention.
URL_START = r"https?://" + NOT_SPACE + r"|www\." + NOT_SPACE
FUSED_MARKUP_PATTERN = URL_PATTERN + r"|@(?:(?!" + URL_START + r")[\p{L}\p{N}_])+"
FUSED_MARKUP_KEYCAP_PATTERN = FUSED_MARKUP_PATTERN + "|" + KEYCAP_PATTERN
ALNUM_RUN = r"[a-zA-Z0-9]+"


def _has_markup(t: Column, strip_keycaps: bool) -> Column:
    # plain byte searches: the regex pass is skipped for text without any marker
    m = t.contains("@") | t.contains("://") | t.contains("www.")
    if strip_keycaps:
        m = m | t.contains("\u20e3")
    return m


def clean_text(c, strip_keycaps: bool = True) -> Column:
    """URL, mention, keycap emoji and special characters become spaces, ``#`` is
    dropped, the text is lower-cased and whitespace collapsed. Null gives ``""``.

    Same result as applying the rules one after another (that form is the SQL
    oracle); here the passes are fused: after markup removal and deleting ``#``,
    the result is the runs of ASCII letters/digits joined by single spaces, which
    covers the special-character, ``#``, collapse and strip steps at once (and
    extracting runs is several times cheaper than replacing the gaps)."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    pat = FUSED_MARKUP_KEYCAP_PATTERN if strip_keycaps else FUSED_MARKUP_PATTERN
    t = F.when(_has_markup(t, strip_keycaps), F.regexp_replace(t, pat, " ")).otherwise(t)
    t = F.replace(t, F.lit("#"), F.lit(""))
    t = F.array_join(F.regexp_extract_all(t, F.lit(ALNUM_RUN), 0), " ")
    return F.lower(t)


def cleans_to_empty(c, strip_keycaps: bool = True) -> Column:
    """True when ``clean_text(c)`` would be empty, without running the regex
    passes unless the text has markup (then it is cleaned for real)."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(_has_markup(t, strip_keycaps), F.length(clean_text(t, strip_keycaps)) == 0) \
        .otherwise(~t.rlike("[a-zA-Z0-9]"))


def has_content(c) -> Column:
    """True when the text has a non-whitespace character (Python ``str.strip() != ""``)."""
    return F.coalesce(_col(c).rlike(NOT_SPACE), F.lit(False))


def is_blank(c) -> Column:
    return ~has_content(c)


def words(c) -> Column:
    """Array of the space separated words of an already cleaned text (``[]`` when empty)."""
    t = _col(c)
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def clean_token(c) -> Column:
    """Normalise one model token for display; null when the token is to be dropped.

    Special tokens are dropped, ``##`` removed, pure punctuation dropped, then lower-cased.
    """
    t = _col(c).cast("string")
    space = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"
    # few tokens have white space at an end: the first and the last character tell
    edge = F.substring(t, 1, 1).rlike(space) | F.substring(t, -1, 1).rlike(space)
    w = F.when(edge, F.regexp_replace(t, f"^{space}+|{space}+$", "")).otherwise(t)
    stripped = F.replace(w, F.lit("##"), F.lit(""))
    keep = (~w.isin(*SPECIAL_TOKENS)) & stripped.rlike("[a-zA-Z0-9]")
    return F.when(keep, F.lower(stripped))
