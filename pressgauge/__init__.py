"""News-signal analytics as plain Spark DataFrame functions."""

from pressgauge.settings import CleaningRules

__all__ = ["CleaningRules"]
