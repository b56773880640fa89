"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.plans import catalogue, expressions, extras, hierarchies, maintenance, searches

_MODULES = (catalogue, expressions, hierarchies, searches, maintenance, extras)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "hybrid_search"
