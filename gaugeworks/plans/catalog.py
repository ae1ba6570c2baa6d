"""Named queries on the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.plans import geometry_queries, graph_queries, integrity_queries, record_queries, stream_queries

_FAMILIES = (record_queries, integrity_queries, graph_queries, geometry_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in _FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
