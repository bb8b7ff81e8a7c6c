"""Thresholds shared by the cleaning steps."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleaningRules:
    min_words: int = 15
    max_words: int = 6500
    min_articles: int = 30
    min_years: int = 2
    min_themes: int = 2
    bad_record_ids: tuple[str, ...] = ("20210925181500-T1111",)


# Largest lookup we ship to every executor; beyond it joins are salted shuffles.
BROADCAST_ROWS = 1_000_000

# How many ways a hot join key is split once a lookup is too large to broadcast.
SALTS = 64

# How many rows of a large table one shuffle partition should hold at most.
SHUFFLE_ROWS = 250_000
