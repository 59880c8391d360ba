"""Name -> query and name -> SQL, collected from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "claims", "fraud", "policy", "ruleset", "documents", "evaluation", "responses", "io", "paths")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for module in MODULES:
        import_module(f"tallyspark.plans.{module}")


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
