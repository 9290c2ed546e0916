"""Numbered lines, snippets and line frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def pat(pattern: str, ignore_case: bool = False) -> str:
    """A pattern in the canonical dialect: Unicode classes, only line feeds end a line."""
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """file_id, path, language, line_no (from 1), line, and the file's columns that are to be kept. File filters stand below the explode."""
    own = ("file_id", "path", "language", *keep)
    return files.select(*own, F.posexplode(F.split("code", "\n", -1)).alias("pos", "line")).select(*own, (F.col("pos") + 1).alias("line_no"), "line")


def is_code(line: Column, slashes: bool = False) -> Column:
    """Neither blank nor a comment."""
    s = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    keep = (s != "") & ~s.startswith("#")
    return keep & ~s.startswith("//") if slashes else keep


def frame(before: int, after: int):
    return Window.partitionBy("file_id").orderBy("line_no").rowsBetween(-before, after)


def any_in(condition: Column, before: int, after: int) -> Column:
    """Whether a line of the frame meets the condition; no text is copied."""
    return F.coalesce(F.max(condition).over(frame(before, after)), F.lit(False))


def snippet(context: int = 2) -> Column:
    """Numbered lines around the current one, `context` before and one more after it."""
    text = F.format_string("%3d| %s", F.col("line_no"), F.col("line"))
    return F.array_join(F.collect_list(text).over(frame(context, context + 1)), "\n")


#: Files of a task of a heavy pass.
TASK_FILES = 50_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Files, or rows that files are made from, dealt to tasks by number: they are few by their bytes, however long each takes."""
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_FILES))
    return rows.repartition(tasks, key)


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the files. It is never broadcast, as scratch files of repeated texts are small by their
    size on disk however many rows they hold."""
    return side.hint("merge")


def html_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
