"""Expected results of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_expected(lines: DataFrame) -> DataFrame:
    """name, category, vulnerable, cwe from rows of `line`; blank lines, comments and lines of fewer than four fields are skipped."""
    kept = lines.filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    fields = kept.select(F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("f")).filter(F.size("f") >= 4)
    return fields.select(F.col("f")[0].alias("name"), F.col("f")[1].alias("category"), (F.lower(F.col("f")[2]) == "true").alias("vulnerable"), F.col("f")[3].try_cast("int").alias("cwe"))


def read_expected(spark, path: str) -> DataFrame:
    return parse_expected(spark.read.text(path).withColumnRenamed("value", "line"))
