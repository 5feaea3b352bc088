"""All queries of the engine's own operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data, evaluation, release, robots, streams, surface

_parts = (data, evaluation, robots, release, streams, surface)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _parts for k, f in p.QUERIES.items()}
SQL: dict[str, str] = {k: s for p in _parts for k, s in p.SQL.items()}
