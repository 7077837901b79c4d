"""Queries of the subpackage and their SQL, where SQL can express them."""

import importlib

_NAMES = (
    "scans_queries",
    "encoding_queries",
    "quality_queries",
    "lookalike_queries",
    "packing_queries",
    "leakage_queries",
    "spans_queries",
)

MODULES = [importlib.import_module(f"leafmill.llm.{name}") for name in _NAMES]
