"""Collects the queries and the checking SQL of every plan module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules with QUERIES (name -> callable) and SQL (name -> text).
MODULES: tuple[str, ...] = ("text", "store", "glossary", "markdown", "layout", "queue", "assembly", "runs")


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"quire.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"quire.plans.{m}").SQL.items()}
