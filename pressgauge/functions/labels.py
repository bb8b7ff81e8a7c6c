"""Bucket labels and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket labels with their inclusive bounds (None = open).
VOLUME_BUCKETS = (
    ("1 article", 1, 1),
    ("2-10 articles", 2, 10),
    ("11-100 articles", 11, 100),
    ("101-1000 articles", 101, 1000),
)
VOLUME_REST = "> 1000 articles"
LONGEVITY_BUCKETS = (
    ("1 an", 1, 1),
    ("2 ans", 2, 2),
    ("3 ans", 3, 3),
    ("4-6 ans", 4, 6),
    ("7-9 ans", 7, 9),
    ("10-12 ans", 10, 12),
)

# Word-count labels with their exclusive upper bound.
WORD_BUCKETS = (
    ("0. < 100 mots ", 100),
    ("1. 100 - 250 mots ", 250),
    ("2. 250 - 500 mots (Article court)", 500),
    ("3. 500 - 1000 mots (Standard presse)", 1000),
    ("4. 1000 - 2000 mots (Article long / Analyse)", 2000),
    ("5. 2000 - 5000 mots (Dossier / Long format)", 5000),
)
WORD_REST = "6. > 5000 mots (Hors norme / Scraping entier de page)"
SHORT_WORD_BUCKETS = (
    ("0. < 10 mots", 10),
    ("1. 10 - 100 mots", 100),
    ("1. 100 - 250 mots", 250),
    ("2. 250 - 500 mots", 500),
    ("3. 500 - 1000 mots", 1000),
    ("4. 1000 - 2000 mots", 2000),
    ("5. 2000 - 5000 mots", 5000),
)
SHORT_WORD_REST = "6. > 5000 mots"


def between_label(value: Column, buckets, rest: str | None = None) -> Column:
    label = F.lit(rest)
    for name, low, high in reversed(buckets):
        label = F.when(value.between(low, high), name).otherwise(label)
    return label


def below_label(value: Column, buckets, rest: str) -> Column:
    """Label of the first bucket whose upper bound exceeds ``value``."""
    label = F.lit(rest)
    for name, bound in reversed(buckets):
        label = F.when(value < bound, name).otherwise(label)
    return label


def volume_label(articles: Column) -> Column:
    return between_label(articles, VOLUME_BUCKETS, VOLUME_REST)


def longevity_label(years: Column) -> Column:
    return between_label(years, LONGEVITY_BUCKETS)


def word_label(words: Column) -> Column:
    return below_label(words, WORD_BUCKETS, WORD_REST)


def short_word_label(words: Column) -> Column:
    return below_label(words, SHORT_WORD_BUCKETS, SHORT_WORD_REST)


def significance_text(coefficient: Column, p_value: Column) -> Column:
    """``+0.00`` style coefficient with stars at the 1, 5 and 10 % levels."""
    stars = (
        F.when(p_value < 0.01, "***").when(p_value < 0.05, "**").when(p_value < 0.10, "*").otherwise(" (ns)")
    )
    return F.when(coefficient == 0, "0.00").otherwise(F.concat(F.format_string("%+.2f", coefficient), stars))


def lag_name(lag: int) -> str:
    """Column name of a lag: ``T-1``, ``T(0)``, ``T+1``."""
    return f"T{lag:+d}" if lag else "T(0)"
