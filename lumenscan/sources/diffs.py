"""Unified diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, path, line_no of every added line, from diffs (diff_id, text).

    Headers are carried forward by windows; within a hunk the new file's line is its start plus the added and context lines before."""
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    order = Window.partitionBy("diff_id").orderBy("k")
    path = F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 20))
    start = F.when(F.col("line").startswith("@@"), F.regexp_extract("line", r"\+(\d+)", 1).try_cast("int"))
    rows = rows.select("*", F.last(path, True).over(order).alias("path"), start.alias("start"), F.last(start, True).over(order).alias("hunk_start"), F.count(start).over(order).alias("hunk"))
    body = rows.filter("hunk > 0 and start is null and path is not null and not startswith(line, '+++ b/')")
    within = Window.partitionBy("diff_id", "hunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.when(F.col("line").startswith("-"), 0).otherwise(1)).over(within), F.lit(0))
    return body.select("diff_id", "path", "line", (F.col("hunk_start") + moved).cast("int").alias("line_no")).filter(F.col("line").startswith("+")).drop("line")
