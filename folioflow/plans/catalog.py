"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    library_queries,
    listing_queries,
    merge_queries,
    model_queries,
    reader_queries,
    search_queries,
    sequence_queries,
    service_queries,
    source_queries,
    stream_queries,
    text_queries,
    value_queries,
    work_queries,
)

MODULES = (
    search_queries,
    text_queries,
    listing_queries,
    sequence_queries,
    value_queries,
    merge_queries,
    stream_queries,
    source_queries,
    model_queries,
    reader_queries,
    library_queries,
    work_queries,
    service_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
