"""Queries over path results in findings and over the run in five phases, with SQL for files and results made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.text import grown
from ..operators import sandbox as B
from ..operators import taint as T
from ..operators.copies import digest, for_all, once
from .flows import all_files
from .general import _made
from .scanning import _q

_KINDS = ("sql injection", "Weak Hash", "SSRF", "xss")
_CALLS = ("cursor.execute", "requests.get", "unheard.of", "os.system")
_INFO = {s[0]: s[1:] for s in T.SINKS}
#: Findings and results by order: line items stand for both. A result reaches a sink on one of six lines.
_FOUND = f"SELECT l_orderkey AS file_id, CAST(row_number() OVER w AS BIGINT) AS finding_id, CAST(l_suppkey % 6 AS INTEGER) AS line_number, list_extract([{', '.join(map(_q, _KINDS))}], CAST(l_partkey % 4 AS INTEGER) + 1) AS vulnerability_type FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_RESULT = f"SELECT l_orderkey AS file_id, CAST(row_number() OVER w AS BIGINT) AS result_id, CAST(l_suppkey % 6 AS INTEGER) AS sink_line, CAST(l_partkey % 5 AS INTEGER) AS mid, CAST(l_partkey % 7 AS INTEGER) AS source_line, list_extract([{', '.join(map(_q, _CALLS))}], CAST(l_partkey % 4 AS INTEGER) + 1) AS sink_api FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0 OR l_partkey % 3 = 0) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_TYPE = "CASE sink_api " + " ".join(f"WHEN {_q(c)} THEN {_q(_INFO[c][0])}" for c in _CALLS if c in _INFO) + " END"
_SEVERITY = "CASE sink_api " + " ".join(f"WHEN {_q(c)} THEN {_q(_INFO[c][2])}" for c in _CALLS if c in _INFO) + " END"


def _findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by order once, which serves the distinct rows, their numbers and what gathers them by file."""
    order = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber % 2 = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("file_id"), F.expr(order).cast("long").alias("finding_id"), (F.col("l_suppkey") % 6).cast("int").alias("line_number"), kind.alias("vulnerability_type"),
        F.lit("LOW").alias("severity"), F.lit("").alias("cwe_id"), F.lit("D").alias("detector_name"), F.lit(0.5).alias("confidence"), F.lit(0).alias("det_ord"),
    )


def _results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber % 2 = 0 or l_partkey % 3 = 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    part = F.col("l_partkey")
    made = rows.select(
        F.col("l_orderkey").alias("file_id"), F.expr(order).cast("long").alias("result_id"), (F.col("l_suppkey") % 6).cast("int").alias("sink_line"), (part % 7).cast("int").alias("source_line"),
        F.array(F.struct((part % 5).cast("int").alias("line"))).alias("transforms"), F.element_at(F.array(*map(F.lit, _CALLS)), (part % 4 + 1).cast("int")).alias("sink_api"),
    )
    made = made.withColumn("i", T.sink_info(F.col("sink_api")))
    typed = [F.coalesce(F.col("i")[c], F.lit(d)).alias(c) for c, d in (("vulnerability_type", "Unknown"), ("severity", "MEDIUM"), ("cwe_id", ""))]
    reached = [F.lit("Confirmed Reachable").alias("reachability_status"), F.concat(F.lit("result "), F.col("result_id").cast("string")).alias("reachability_reasoning"), F.lit("p").alias("attack_path")]
    return made.select("file_id", "result_id", "sink_line", "source_line", "transforms", "sink_api", F.col("i").isNotNull().alias("known"), *typed, *reached)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "line_number", "detector_name", "vulnerability_type", "severity", "sink_api", "reachability_reasoning")


_TAKEN = f"""WITH RECURSIVE f AS ({_FOUND}), r AS ({_RESULT}), n AS (SELECT file_id, max(result_id) AS n FROM r GROUP BY 1),
a AS (SELECT r.file_id, r.result_id, f.finding_id, CASE WHEN f.line_number = r.sink_line AND lower(f.vulnerability_type) = lower(coalesce({_TYPE}, 'Unknown')) THEN 0 WHEN f.line_number = r.sink_line THEN 1 WHEN f.line_number = r.mid THEN 2 ELSE 3 END AS tier
  FROM r JOIN f ON f.file_id = r.file_id AND f.line_number IN (r.sink_line, r.mid, r.source_line)),
c AS (SELECT file_id, result_id, list(finding_id ORDER BY tier, finding_id) AS options FROM a GROUP BY 1, 2),
g(file_id, k, taken, pick) AS (SELECT file_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM n
  UNION ALL SELECT file_id, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT g.file_id, g.k + 1 AS k, g.taken, list_filter(coalesce(c.options, CAST([] AS BIGINT[])), lambda x: NOT list_contains(g.taken, x))[1] AS pick
    FROM g JOIN n ON n.file_id = g.file_id AND g.k < n.n LEFT JOIN c ON c.file_id = g.file_id AND c.result_id = g.k + 1)),
t AS (SELECT r.*, {_TYPE} AS kind, {_SEVERITY} AS sev, g.pick FROM r JOIN g ON g.file_id = r.file_id AND g.k = r.result_id)"""


@query(f"""{_TAKEN}
SELECT f.file_id, f.line_number, 'D' AS detector_name, coalesce(t.kind, f.vulnerability_type) AS vulnerability_type, coalesce(t.sev, 'LOW') AS severity, t.sink_api, 'result ' || t.result_id AS reachability_reasoning FROM f LEFT JOIN t ON t.file_id = f.file_id AND t.pick = f.finding_id
UNION ALL SELECT file_id, sink_line, {_q(B.PIPELINE)}, coalesce(kind, 'Unknown'), coalesce(sev, 'MEDIUM'), sink_api, 'result ' || result_id FROM t WHERE pick IS NULL""")
def lay_exclusive_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that take one finding each, overwrite it, or become findings."""
    return _shown(B.lay_exclusive(_findings_of(spark, sf_dir), _results_of(spark, sf_dir)))


_LINES_OF = f"""WITH f AS ({_FOUND}), r AS (SELECT *, {_TYPE} AS kind, {_SEVERITY} AS sev FROM ({_RESULT})),
g AS (SELECT file_id, sink_line AS line_number, min(result_id) AS first, max(result_id) AS last, max(CASE WHEN kind IS NOT NULL THEN result_id END) AS typed FROM r GROUP BY 1, 2),
h AS (SELECT g.*, a.sink_api AS first_api, a.kind AS first_kind, a.sev AS first_sev, b.sink_api AS last_api, c.kind, c.sev FROM g JOIN r a ON a.file_id = g.file_id AND a.result_id = g.first JOIN r b ON b.file_id = g.file_id AND b.result_id = g.last LEFT JOIN r c ON c.file_id = g.file_id AND c.result_id = g.typed),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, line_number ORDER BY finding_id) AS place FROM f)"""


@query(f"""{_LINES_OF}
SELECT o.file_id, o.line_number, 'D' AS detector_name, coalesce(h.kind, o.vulnerability_type) AS vulnerability_type, coalesce(h.sev, 'LOW') AS severity, h.last_api AS sink_api, 'result ' || h.last AS reachability_reasoning
FROM o LEFT JOIN h ON h.file_id = o.file_id AND h.line_number = o.line_number AND o.place = 1
UNION ALL SELECT h.file_id, h.line_number, {_q(B.PIPELINE)}, coalesce(h.kind, 'Unknown'), coalesce(h.sev, 'MEDIUM'), h.last_api, 'result ' || h.last FROM h ANTI JOIN f ON f.file_id = h.file_id AND f.line_number = h.line_number""")
def lay_last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results laid over the first finding of their line, the last one staying."""
    return _shown(B.lay_last(_findings_of(spark, sf_dir), _results_of(spark, sf_dir)))


@query(f"""{_LINES_OF}
SELECT file_id, line_number, 'D' AS detector_name, vulnerability_type, 'LOW' AS severity, CAST(NULL AS VARCHAR) AS sink_api, CAST(NULL AS VARCHAR) AS reachability_reasoning FROM f
UNION ALL SELECT h.file_id, h.line_number, {_q(B.PIPELINE)}, coalesce(h.first_kind, 'Unknown'), coalesce(h.first_sev, 'MEDIUM'), h.first_api, 'result ' || h.first FROM h ANTI JOIN f ON f.file_id = h.file_id AND f.line_number = h.line_number""")
def lay_missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, and one of a path for each line without any."""
    return _shown(B.lay_missing(_findings_of(spark, sf_dir), _results_of(spark, sf_dir)))


#: Files by place, and what must come of them: (code, findings before, fixes, rejected, findings after).
FILES = (
    ("import hashlib\nh = hashlib.md5(x{a})", "2 Weak Hash", 1, 0, ""),
    ("u = input()\nos.system(u)", "2 Command Injection Confirmed Reachable", 1, 0, ""),
    ("u = input()\nq = f\"SELECT {u}\"\ncursor.execute(q)", "3 SQL Injection Confirmed Reachable", 2, 0, ""),
    ("app.run(debug=True, port={a})", "1 Debug Mode Enabled", 1, 0, ""),
    ("n = input()\neval(n)", "2 Code Execution Confirmed Reachable", 0, 1, "2 Code Execution Confirmed Reachable"),
    ("n = {a}\nprint(n)", "", 0, 0, ""),
    ("v = os.environ.get('A')\nos.system(v)", "2 Command Injection Requires Manual Review", 1, 0, "3 Command Injection Reachability Eliminated"),  # as a finding, by type
    ("u = input()\nsubprocess.run(u, shell=True)\nh = hashlib.md5(b)", "2 Command Injection Confirmed Reachable;3 Weak Hash", 2, 0, ""),
)


def _of(column: int) -> str:
    return f"CASE o_orderkey % {len(FILES)} " + " ".join(f"WHEN {k} THEN {_q(f[column]) if isinstance(f[column], str) else f[column]}" for k, f in enumerate(FILES)) + " END"


def _told(rows: DataFrame, name: str) -> DataFrame:
    one = F.concat_ws(" ", F.col("line_number").cast("string"), "vulnerability_type", "reachability_status")
    return rows.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias(name))


@query(f"SELECT o_orderkey AS file_id, {_of(1)} AS before, CAST({_of(2)} AS BIGINT) AS n_fixed, CAST({_of(3)} AS BIGINT) AS n_rejected, {_of(4)} AS after FROM orders")
def sandbox_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five phases over a file made from each order: findings before, fixes, findings after."""
    rows = _made(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 90 AS a"), F.col("o_orderkey") % len(FILES), [f[0] for f in FILES], "a")
    files = rows.select(F.col("o_orderkey").alias("file_id"), F.lit("f.py").alias("path"), F.lit("python").alias("language"), F.col("made").alias("code"))
    files = files.withColumn("text_id", digest("path", "language", "code"))
    return for_all(files, _phases(once(files, "path", "language", "code")), "left")


def _phases(files: DataFrame) -> DataFrame:
    """text_id, and what came of the five phases over the text: findings before, numbers of fixes, findings after."""
    before, diffs, after = B.run(files)
    counts = diffs.groupBy("file_id").agg(F.count_if("is_functional").alias("n_fixed"), F.count_if(~F.col("is_functional")).alias("n_rejected"))
    out = files.select("file_id", "text_id").join(grown(_told(before, "before")), "file_id", "left").join(grown(counts), "file_id", "left").join(grown(_told(after, "after")), "file_id", "left")
    return out.select("text_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("n_fixed", F.lit(0)).alias("n_fixed"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.coalesce("after", F.lit("")).alias("after"))


@query()
def sandbox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five phases over the documents and the snippets: each finding, and whether it was eliminated, remains or is new. No SQL, as
    syntax trees decide; `sandbox_of_orders` has it."""
    before, _, after = B.run(all_files(spark, sf_dir))
    side = lambda rows, name: rows.select("file_id", "line_number", "vulnerability_type", "severity", F.coalesce("sink_api", F.lit("")).alias("sink_api")).distinct().withColumn(name, F.lit(True))
    both = side(before, "was").join(grown(side(after, "stays")), ["file_id", "line_number", "vulnerability_type", "severity", "sink_api"], "full")
    return both.select("file_id", "line_number", "vulnerability_type", "severity", "sink_api", F.when(F.col("stays").isNull(), "eliminated").when(F.col("was").isNull(), "introduced").otherwise("remaining").alias("status"))


@query()
def taint_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's taint graph as JSON. No SQL, as syntax trees decide."""
    return T.graph_json(*T.graph(T.facts(all_files(spark, sf_dir))))
