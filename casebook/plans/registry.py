"""Registered driver queries: one Spark job per operator family plus the
equivalent DuckDB statement used as the correctness oracle.

Every job reads whole driver tables (``sf_dir``) and returns a DataFrame;
nothing is collected.  Doubles that come out of sums are rounded to 6 places
in both engines so summation order cannot change the comparison.
"""

from __future__ import annotations

import importlib
import traceback
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


MODULES = ["q_text", "q_conversation", "q_findings", "q_retrieval", "q_ranking", "q_prompting",
           "q_activity", "q_logs", "q_extra", "q_search", "q_gap", "q_storage", "q_files"]


def load_all() -> None:
    """Import the modules that register queries.  A module that fails is
    reported and leaves the queries of the others registered."""
    for name in MODULES:
        try:
            importlib.import_module(f"{__package__}.{name}")
        except Exception:  # noqa: BLE001
            warnings.warn(f"queries of {name} are not registered:\n{traceback.format_exc()}", stacklevel=2)
