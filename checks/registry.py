"""Every registered query: name -> (spark callable, DuckDB text or None)."""
from __future__ import annotations

from importlib import import_module

MODULES = ["feature_queries", "model_queries", "report_queries", "flow_queries", "extra_queries", "stream_queries",
           "signal_queries"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        entries = import_module(f"checks.{name}").build()
        clash = out.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= entries
    return out
