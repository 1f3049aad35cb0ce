"""Registered queries over the test tables, each with a DuckDB oracle.

Every entry is ``name -> (fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Queries read whole tables (no id subsets, no row caps); stand-ins for tables
the test data lacks are *derived* from the given tables inside the query and
repeated in the oracle (see ``draftsmith.catalog.derived``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    group: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None, group: str = "misc"):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql, group)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Imported for their registrations.
    from draftsmith.catalog import prep  # noqa: F401

    for mod in ("vocab", "examples", "sampling", "quality", "evaluation", "training_logs", "regen", "streams", "files", "stores", "templates"):
        try:
            __import__(f"draftsmith.catalog.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"draftsmith.catalog.{mod}":
                raise
    return REGISTRY
