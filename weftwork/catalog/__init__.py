"""Registered queries over the given tables, each with the SQL that must give the same rows."""

import importlib

MODULES = ["functions", "rows", "joins", "aggregates", "validations", "sources", "targets", "history", "graphs", "recipes"]


def load() -> None:
    """Import every catalogue module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"weftwork.catalog.{name}")
