"""Registered queries: each one a Spark callable with its reference SQL."""

from importlib import import_module

_MODULES = (
    "features",
    "aggregates",
    "exports",
    "joins",
    "comparison",
    "review",
    "symbols",
    "detections",
    "grid",
    "georeference",
    "sheet_metadata",
    "country",
    "cleaning",
    "search",
    "intake",
    "flagship",
)


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for module in _MODULES:
        import_module(f"sheetlore.plans.{module}")
