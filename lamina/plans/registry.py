"""Queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "segmentation_score"


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add



from lamina.plans import queries_bands, queries_blocks, queries_closed, queries_composites, queries_image, queries_kernels, queries_native, queries_steady  # noqa: E402, F401
