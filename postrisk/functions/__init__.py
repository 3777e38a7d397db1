"""Column -> Column building blocks (all JVM-side, codegen friendly)."""

from postrisk.functions.text import clean_text, has_content, is_blank, words, clean_token
from postrisk.functions.scores import (
    coerce_count, parse_ts, hours_between, amplification, velocity, risk_score, zone,
    response, apply_threshold, round6,
)

__all__ = [
    "clean_text", "has_content", "is_blank", "words", "clean_token", "coerce_count", "parse_ts",
    "hours_between", "amplification", "velocity", "risk_score", "zone", "response",
    "apply_threshold", "round6",
]
