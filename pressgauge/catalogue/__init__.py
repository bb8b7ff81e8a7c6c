"""Registered queries, one per operator, with their SQL counterparts."""

from importlib import import_module

MODULES = (
    "cleaning_queries",
    "indicator_queries",
    "profile_queries",
    "feature_queries",
    "series_queries",
    "model_queries",
    "ingest_queries",
)


def load():
    from pressgauge.catalogue import registry

    for module in MODULES:
        import_module(f"pressgauge.catalogue.{module}")
    return registry
