"""Queries over all detectors together, and over the fixes of their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import query, table
from ..operators import remediate as R
from ..operators import union as U
from .flows import all_files
from .scanning import _KEY_SQL, _OWNER_SQL, _q
from . import scoped, web  # noqa: F401  their SQL is read below

_BY_TREE = ("det_signed_loads",)  # SQL by the layout of lines only


def _part_sql(name: str) -> str:
    if name == "det_races":
        return f"SELECT file_id, line_number, 'TOCTOUDetector' AS detector_name, 'TOCTOU Race Condition' AS vulnerability_type, 'HIGH' AS severity, 'CWE-367' AS cwe_id, CAST(0.85 AS DOUBLE) AS confidence FROM ({catalog._SQL['det_toctou_asof']})"
    return f"SELECT {', '.join(U.COLUMNS)} FROM ({catalog._SQL[name]})"


_UNION = " UNION ALL ".join(f"SELECT *, {k} AS det_ord FROM ({_part_sql(name)})" for k, (name, _) in enumerate(U.PARTS) if name not in _BY_TREE)

_WHOLE = _UNION + "".join(f" UNION ALL SELECT {', '.join(U.COLUMNS)}, {k} AS det_ord FROM ({scoped.SIGNED_LOADS_SQL})" for k, (name, _) in enumerate(U.PARTS) if name in _BY_TREE)


@query(f"SELECT {', '.join(U.COLUMNS)}, CAST(det_ord AS INTEGER) AS det_ord FROM ({_UNION})")
def det_union_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector that needs no syntax tree, in the order of registration."""
    return U.all_findings(all_files(spark, sf_dir), without=_BY_TREE)


@query(f"SELECT DISTINCT file_id, line_number, lower_type, detector_name, det_ord FROM (SELECT *, {_KEY_SQL} AS lower_type FROM ({_WHOLE}) QUALIFY row_number() OVER (PARTITION BY file_id, line_number, {_KEY_SQL} ORDER BY coalesce({_OWNER_SQL} = detector_name, false) DESC, confidence DESC, det_ord) = 1)")
def dedup_union_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each finding of all detectors, the one by syntax trees included."""
    from ..operators.detectors import dedup

    kind = F.lower("vulnerability_type")
    best = dedup(U.all_findings(all_files(spark, sf_dir)))
    return best.select("file_id", "line_number", F.when(kind == "attribute injection", "mass assignment").otherwise(kind).alias("lower_type"), "detector_name", "det_ord")


@query()
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan of the documents and the snippets, syntax trees included: the best finding of each file, line and type."""
    return U.scan(all_files(spark, sf_dir))


@query()
def fix_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of the findings in the snippets. No SQL, as back references decide; tests hold the expected lines."""
    files = U.narrowed(all_files(spark, sf_dir))
    return R.apply_fixes(files, U.all_findings(files, narrow=False))[1]


_KINDS = ("Code Execution", "Unsafe Deserialization", "Path Traversal", "XSS / Template Injection", "SSRF", "ReDoS", "Open Redirect", "Command Injection", "SQL Injection", "Weak Hash")
_ADVICE = " ".join(f"WHEN regexp_matches(lower(kind), {_q(part)}) AND contains(line, {_q(call)}) THEN {_q(text)}" for part, call, text in R.BY_HAND)


@query(f"""SELECT doc_id, kind, CASE {_ADVICE} ELSE 'Review this ' || kind || ' finding manually. Apply input validation, use safe API alternatives, and enforce least-privilege access.' END AS advice
FROM (SELECT doc_id, list_extract([{", ".join(map(_q, _KINDS))}], CAST(doc_id % {len(_KINDS)} AS INTEGER) + 1) AS kind, (CASE doc_id % 3 WHEN 0 THEN 'eval(' WHEN 1 THEN 'exec(' ELSE '' END) || text AS line FROM documents)""")
def fix_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do by hand, by type and line."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, "eval(").when(F.col("doc_id") % 3 == 1, "exec(").otherwise(""), "text")
    return docs.select("doc_id", kind.alias("kind"), line.alias("line")).select("doc_id", "kind", R.by_hand(F.col("kind"), F.col("line")).alias("advice"))
