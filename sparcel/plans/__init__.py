"""Registered queries: each builds a DataFrame and, where SQL can say it, carries a SQL twin."""

from __future__ import annotations

from sparcel.plans.catalog import CATALOG, Query, query


def load_all() -> dict[str, Query]:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")

    return CATALOG
