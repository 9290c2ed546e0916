"""Queries over what is written and read back: warehouse tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..sources import knowledge as K
from ..sources import warehouse as W
from ..streaming import events as E
from ..streaming import progress as P
from .analytics import _F, findings


@query(f"""SELECT scan_id, ordinal, severity, CASE WHEN o_orderstatus = 'F' THEN 'explained ' || o_orderpriority ELSE 'open' END AS note
FROM {_F} JOIN orders ON o_orderkey = scan_id WHERE severity <> 'LOW'""")
def warehouse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings inserted in two parts, texts set for the scans that have ended, one level deleted, read back."""
    path = W.scratch(spark, "findings")
    rows = findings(spark, sf_dir).select("scan_id", "ordinal", "severity", F.lit("open").alias("note"))
    W.insert(rows.filter("severity in ('CRITICAL', 'HIGH')"), path)
    W.insert(rows.filter("severity not in ('CRITICAL', 'HIGH')"), path)
    ended = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    W.update(spark, path, ended.select(F.col("o_orderkey").alias("scan_id"), F.concat(F.lit("explained "), "o_orderpriority").alias("note")), "scan_id")
    W.delete(spark, path, F.col("severity") == "LOW")
    return W.read(spark, path).select("scan_id", "ordinal", "severity", "note")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and kind, from the events read as a stream."""
    path = W.scratch(spark, "windows")
    stream = E.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    E.keep_up(E.windows(stream), f"{path}/table", f"{path}/state")
    return spark.read.parquet(f"{path}/table")


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END AS kind FROM events),
l AS (SELECT *, min(CASE WHEN kind IN ('complete', 'error') THEN seq END) OVER (PARTITION BY job_id) AS until FROM e)
SELECT job_id, seq, 'data: {"type": "' || kind || '"}' || chr(10) || chr(10) AS message FROM l WHERE until IS NULL OR seq <= until""")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of jobs (users), from the events read as a stream, up to each job's end."""
    path = W.scratch(spark, "progress")
    stream = E.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type"))
    P.write(P.messages(stream.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"))), f"{path}/table", f"{path}/state")
    return spark.read.schema(P.OUT).parquet(f"{path}/table").filter("seq is not null")


@query("""WITH first AS (SELECT source, 1 AS version, count(*) AS n_docs FROM documents WHERE source IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY source),
again AS (SELECT source, 2 AS version, count(*) FILTER (doc_id % 3 = 0) AS n_docs FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 0 GROUP BY source HAVING md5(source) < '8'),
every AS (SELECT * FROM again UNION ALL SELECT * FROM first WHERE source NOT IN (SELECT source FROM again))
SELECT source, CAST(version AS INTEGER) AS version, n_docs FROM every WHERE source <> (SELECT min(source) FROM documents)""")
def kb_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a knowledge base after all documents came in, half of the sources came in anew, and one was removed."""
    docs, path = table(spark, sf_dir, "documents"), W.scratch(spark, "kb")
    K.put(docs, path)
    K.put(docs.filter((F.col("doc_id") % 3 == 0) & (F.md5("source") < "8")), path)
    K.remove(spark, path, docs.agg(F.min("source")).first()[0])
    return K.sources(spark, path)


@query()
def kb_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest chunks of the documents for each benchmark item. No SQL, as vectors come from hashes; tests compare with brute force."""
    docs, path = table(spark, sf_dir, "documents"), W.scratch(spark, "kb")
    K.put(docs, path)
    return K.retrieve(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text"), path)
