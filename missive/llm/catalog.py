"""The queries of the training-data operators, by name, and the SQL they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("authored", "consensus", "conversations", "groups", "language", "leakage", "packing", "pii", "splits")


# Imported here, so that the whole subpackage can or cannot be imported, whatever package is missing.
_LOADED = [importlib.import_module(f"missive.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _LOADED for k, f in vars(m).items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _LOADED if hasattr(m, "oracle_sql") for k, s in m.oracle_sql().items()}
