"""Equal texts are worked on once, and what comes of a text holds for every file that has it.

This is for work that looks at nothing but the text (and the columns named with it). Texts are grouped whole, so only files whose
columns are all equal share it; the digest (SHA-256) is what results travel back by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dealt, grown
from ..sources.warehouse import written


def digest(*columns: str) -> Column:
    """Digest of the columns, each with its length before it; a null differs from every text. It is never null and says so: else
    joins by it test it first, for which Spark works out anew all it is made of."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.coalesce(F.unhex(F.sha2(F.concat(*map(part, columns)), 256)), F.lit(b""))


def once(files: DataFrame, *columns: str) -> DataFrame:
    """text_id, the columns and file_id (the smallest of the files with that text), one row per text. `files` has text_id, the
    digest of these columns. Written, so that no filter of the work is pushed below the grouping, and dealt to tasks by number."""
    return dealt(written(files.groupBy("text_id", *columns).agg(F.min("file_id").alias("file_id")), "texts"), "text_id")


def for_all(files: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of texts (text_id and more) for each of the files (file_id, text_id); text_id goes."""
    return files.select("file_id", "text_id").join(grown(rows), "text_id", how).drop("text_id")
