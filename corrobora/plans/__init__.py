"""Registered queries: every operator run over the driver tables."""

from __future__ import annotations


def all_queries():
    import importlib
    import pkgutil

    from corrobora.plans.registry import QUERIES

    for mod in pkgutil.iter_modules(__path__):
        if mod.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return QUERIES
