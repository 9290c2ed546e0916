"""Source files of a folder as a table, read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions with their languages, what is left out, the size limit.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin"}
EXCLUDED = ("__pycache__", ".git", "node_modules", "venv", ".env")
MAX_BYTES = 10 * 1024 * 1024


def language_of(path: Column) -> Column:
    """The language of an extension, null if it is none of a language."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are that, else Latin-1; every kind of line end becomes a line feed."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_files(spark: SparkSession, path: str, recursive: bool = True, exclude: tuple[str, ...] = EXCLUDED, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of a folder or of one file, whose kind must be known.

    files: file_id, path, file_name, language, code, file_hash, file_size_bytes, line_count. file_id is a hash of the path.
    rejected: path, file_size_bytes, error, for files that are too large; their contents are never read, as the length is
    tested by the scan. Files that vanish or cannot be read don't end the scan. Empty files, which Spark's reader leaves out,
    paths that hold an excluded part and files of other kinds appear in neither."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    found = reader.load(path).withColumn("language", language_of(F.col("path"))).filter("language is not null")
    for part in exclude:
        found = found.filter(~F.contains("path", F.lit(part)))
    good = found.filter(F.col("length") <= max_bytes).withColumn("code", decoded(F.col("content")))
    files = good.select(
        F.xxhash64("path").alias("file_id"), "path", F.substring_index("path", "/", -1).alias("file_name"), "language", "code", F.sha2("code", 256).alias("file_hash"),
        F.col("length").alias("file_size_bytes"), (F.regexp_count("code", F.lit("\n")) + 1).alias("line_count"),
    )
    return files, found.filter(F.col("length") > max_bytes).select("path", F.col("length").alias("file_size_bytes"), F.lit("File too large").alias("error"))
