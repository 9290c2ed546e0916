"""A user's own detectors: table functions in a lateral join, and detectors switched on and off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .union import COLUMNS, PARTS, all_findings

#: What a detector's `eval(code, language, path)` yields: line, type, severity, CWE and confidence.
FINDING = "line_number int, vulnerability_type string, severity string, cwe_id string, confidence double"


def detect_with(files: DataFrame, name: str, detector: type, language: str | None = None) -> DataFrame:
    """Findings of a user's detector over all files, in the columns of the others.

    detector: a class whose `eval(self, code, language, path)` yields tuples as in FINDING. It runs as a table function in a
    lateral join, a file at a time, in the tasks; a null code is handed over as it is. language: files of that one only."""
    spark = files.sparkSession
    function = f"detector_{detector.__name__.lower()}"
    spark.udtf.register(function, F.udtf(detector, returnType=FINDING))
    some = files if language is None else files.filter(F.col("language") == language)
    rows = spark.sql(f"SELECT f.file_id, d.* FROM {{files}} f, LATERAL {function}(f.code, f.language, f.path) d", files=some)
    return rows.withColumn("detector_name", F.lit(name)).select(*COLUMNS)


def enabled_findings(files: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """The union of the detectors that are on; those not named are on. Only their scans run."""
    return all_findings(files, tuple(part for part, _ in PARTS if not enabled.get(part, True)))
