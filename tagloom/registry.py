"""All queries of the library by name, each with its oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tagloom import plans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("geometry", "index", "ingest", "captions", "batches", "numeric", "lifecycle", "produce")


def _load() -> None:
    for m in MODULES:
        import_module(f"tagloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(plans.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index filtered, cut into buckets and counted."""
    return queries()["index_then_bucket_report"](spark, sf_dir)
