"""Scans and findings kept as Parquet tables: inserts, updates and deletes by version.

A table is a folder of versions. An insert adds files to the newest one; an update or a delete writes the next, as Parquet files
do not change in place. Readers take the newest version, which the partition column prunes to. A job that fails before it
commits leaves the version before it in force; one that dies while it moves its files into place may leave a part of the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "table_version"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: within the cluster's checkpoint folder; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="lumenscan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, as several steps read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _newest(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.parquet(path).agg(F.max(VERSION)).first()[0]
    except AnalysisException:  # nothing has been written yet
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's present rows."""
    return spark.read.parquet(path).filter(F.col(VERSION) == _newest(spark, path)).drop(VERSION)


def _write(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(VERSION).parquet(path)


def insert(rows: DataFrame, path: str) -> None:
    """Appends rows, each with an id of its own (row_id) and the time of its insertion (inserted_at)."""
    stamped = rows.withColumn("row_id", F.expr("uuid()")).withColumn("inserted_at", F.current_timestamp())
    _write(stamped, path, _newest(rows.sparkSession, path) or 0)


def update(spark: SparkSession, path: str, changes: DataFrame, key: str) -> None:
    """Sets the columns of `changes` in the rows that have its key; `changes` holds each key once. A null changes nothing."""
    rows, columns = read(spark, path), [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"new_{c}") for c in columns))
    merged = rows.join(new, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))
    _write(merged, path, _newest(spark, path) + 1)


def delete(spark: SparkSession, path: str, condition: Column) -> None:
    """Drops the rows that meet the condition; rows for which it is null stay. A table that loses all rows is left as it is
    but for them: its next version has one empty file."""
    kept = read(spark, path).filter(~F.coalesce(condition, F.lit(False)))
    _write(kept, path, _newest(spark, path) + 1)
