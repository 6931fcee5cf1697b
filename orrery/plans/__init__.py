"""Queries on the test tables, registered in ``catalog``."""

from importlib import import_module

MODULES = ("code_graph", "ranking", "duplicates", "text", "maintenance")


def load():
    """The catalog with all queries registered."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.catalog")
