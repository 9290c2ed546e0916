"""Pull requests made from orders: each order is one, its line items are the files that it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..sources import pulls as P

_ENDINGS = ("/part.py", "/part.js", "/part.ts", "/part.md", "/part.tar.gz", "/Makefile", "/part.PY")


def pull_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per line item (equal ones are one file, as a pull request names each once): its name by the supplier, a patch of two hunks from its figures, no body where it was returned."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("l_suppkey") % len(_ENDINGS) + 1).cast("int"))
    name = F.concat(F.lit("src/line."), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag", ending)
    at, more = F.col("l_partkey"), F.col("l_quantity").cast("int")
    hunk = lambda start, *body: F.concat(F.lit("@@ -1,4 +"), start.cast("string"), F.lit(",9 @@ def f():\n"), *body)
    added = F.repeat(F.lit("+x = 1\n"), more % 4)
    patch = F.concat(hunk(at, F.lit(" a\n-b\n"), added, F.lit("-c\n d\n+e\n")), hunk(at + 100, F.lit("+f\n\\ No newline at end of file")))
    body = F.when(F.col("l_returnflag") != "R", F.lit("x = 1"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), name.alias("filename"), patch.alias("patch"), body.alias("content")).distinct()


_FILES = f"""(SELECT DISTINCT l_orderkey AS number, 'src/line.' || l_linenumber || '-' || l_partkey || '-' || CAST(floor(l_quantity) AS INTEGER) || l_returnflag || {list(_ENDINGS)}[CAST(l_suppkey % {len(_ENDINGS)} + 1 AS INTEGER)] AS filename, l_partkey AS start,
  CAST(floor(l_quantity) AS INTEGER) % 4 AS k, l_returnflag <> 'R' AND l_suppkey % {len(_ENDINGS)} < 3 AS scanned FROM lineitem)"""


@query(f"""SELECT number, filename, CAST(start + 1 + i AS INTEGER) AS line_no FROM {_FILES}, range(0, 4) r(i) WHERE scanned AND i < k
UNION ALL SELECT number, filename, CAST(start + k + 2 AS INTEGER) FROM {_FILES} WHERE scanned UNION ALL SELECT number, filename, CAST(start + 100 AS INTEGER) FROM {_FILES} WHERE scanned""")
def pull_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines added by the files of pull requests that a scan takes."""
    return P.changed_in_pulls(pull_files(spark, sf_dir).filter(P.in_scope()))


@query(f"SELECT number, count(*) AS n_files, count(*) FILTER (scanned) AS n_scanned FROM {_FILES} GROUP BY number")
def pull_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each pull request, and how many of them are scanned."""
    return pull_files(spark, sf_dir).groupBy("number").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(P.in_scope()).alias("n_scanned"))
