"""All registered queries. Importing the modules fills the registry."""

from importlib import import_module

MODULES = ("panels", "cross_section", "expressions", "quality", "walk", "evaluation", "models")


def _load():
    for name in MODULES:
        import_module(f"panelforge.catalog.{name}")
    return import_module("panelforge.catalog.base")


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
