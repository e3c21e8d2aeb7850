"""Registered queries: one per operator, each with its oracle SQL where one exists.

Every query reads the driver tables (or views Spark derives from them), so
its work grows with the scale factor.  Double results are rounded on both
sides so that two engines' summation orders compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so their ``register`` calls run."""
    import importlib
    for mod in ("profile", "clean", "transform", "recipe", "split", "evaluate", "models", "select",
                "explain", "io"):
        try:
            importlib.import_module(f"tabloom.plans.catalog.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"tabloom.plans.catalog.{mod}":
                raise
