"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT source, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


def _load() -> None:
    """Modules that register queries."""
    from .plans import analytics, extension, flows, general, pulls, reports, sandbox, scanning, scoped, stores, union, web  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every scan by severity."""
    from .plans.analytics import severity_counts

    return severity_counts(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
