"""Loads the modules that register queries."""

from pressgauge.llm import chat, decontamination, jaccard, lines, minhash, mixing, negatives, periods, quality, secrets, shards, substrings, toxicity  # noqa: F401
from pressgauge.llm.common import ORACLES, QUERIES  # noqa: F401
