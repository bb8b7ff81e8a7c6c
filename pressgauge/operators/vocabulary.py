"""Keyword rules that pick theme lists from a vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The trailing count of a vocabulary line.
TRAILING_COUNT = r"(?:\s*_\s*|\s*)\d+$"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w.upper()) for w in words)


def pick_themes(
    lines: DataFrame, strict: list[str], flexible: list[str], exclude: list[str], column: str = "value"
) -> DataFrame:
    """Lines with a strict whole word or a flexible substring, none excluded.

    Java's ``\\b`` counts ``_`` as part of a word: strict ``SOIL`` does not
    hit ``WB_SOIL``.
    """
    text = F.trim(column)
    upper = F.upper(text)
    keep = F.lit(False)
    if strict:
        keep = keep | upper.rlike(r"\b(" + _any(strict) + r")\b")
    if flexible:
        keep = keep | upper.rlike(_any(flexible))
    if exclude:
        keep = keep & ~upper.rlike(_any(exclude))
    theme = F.regexp_replace(text, TRAILING_COUNT, "")
    return lines.filter(keep).select(theme.alias("theme")).filter(F.col("theme") != "")
