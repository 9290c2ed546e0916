"""Queries over web handlers, prompts and agents' tools, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import injection as I
from ..operators import web as W
from .scanning import _ALL, _FILES, _LINES, _near_taint_sql, _q, all_files

_PYTHON = f"SELECT l.*, f.code FROM ({_LINES}) l JOIN ({_FILES}) f ON f.file_id = l.file_id WHERE f.language = 'python'"
_SCRIPTS = f"SELECT l.* FROM ({_LINES}) l JOIN ({_FILES}) f ON f.file_id = l.file_id WHERE f.language IN {I.LANGUAGES}"


def _constants(name: str, kind: str, severity: str, cwe: str, confidence: float) -> str:
    return f"{_q(name)} AS detector_name, {_q(kind)} AS vulnerability_type, {_q(severity)} AS severity, {_q(cwe)} AS cwe_id, CAST({confidence} AS DOUBLE) AS confidence"


def _frame(pattern: str, before: int, after: int) -> str:
    return f"bool_or(regexp_matches(line, {_q(pattern)})) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


def _rule_sql(r: W.LineRule) -> str:
    return f"""SELECT file_id, line_no AS line_number, {_constants(W.OPERATIONAL, r.vulnerability_type, r.severity, r.cwe_id, r.confidence)}
    FROM (SELECT *, {_frame(*r.need)} AS needed, {_frame(*r.skip)} AS excused FROM ({_PYTHON})) WHERE regexp_matches(line, {_q(r.pattern)}) AND needed AND NOT excused"""


@query(_rule_sql(W.UPLOAD))
def det_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.line_rule(all_files(spark, sf_dir), W.UPLOAD)


@query(_rule_sql(W.DISCLOSURE))
def det_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.line_rule(all_files(spark, sf_dir), W.DISCLOSURE)


@query(_rule_sql(W.RATE_LIMIT))
def det_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.line_rule(all_files(spark, sf_dir), W.RATE_LIMIT)


@query(f"""SELECT file_id, CAST(coalesce(min(line_no) FILTER (contains(line, 'Flask(')), 1) AS INTEGER) AS line_number, {_constants(W.OPERATIONAL, "Missing Security Headers", "MEDIUM", "CWE-693", 0.60)}
FROM ({_PYTHON}) GROUP BY file_id HAVING (bool_or(regexp_matches(line, {_q(W.ROUTE)})) OR bool_or(contains(line, 'Flask('))) AND NOT bool_or(regexp_matches(line, {_q(W.HEADER_HINTS)}))""")
def det_missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.missing_headers(all_files(spark, sf_dir))


@query(f"""SELECT file_id, min(line_no) AS line_number, {_constants(W.OPERATIONAL, "Missing CSRF Protection", "HIGH", "CWE-352", 0.62)}
FROM (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS region FROM ({_PYTHON}))
WHERE NOT regexp_matches(code, {_q(W.CSRF_HINTS)}) AND regexp_matches(line, {_q(W.ROUTE)}) AND regexp_matches(region, {_q(W.CHANGING)}) GROUP BY file_id""")
def det_missing_csrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.missing_csrf(all_files(spark, sf_dir))


@query(_near_taint_sql(W.TRUST))
def det_trust_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.near_taint(all_files(spark, sf_dir), W.TRUST)


_PROMPTS = " UNION ALL ".join(f"SELECT file_id, line_no AS line_number, {k} AS pattern_no, unnest(regexp_extract_all(line, {_q('(?i)' + p)}, 0)) AS matched_text FROM m" for k, p in enumerate(W.PROMPT_PATTERNS))


@query(f"""WITH m AS (SELECT * FROM ({_SCRIPTS}) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(12)) <> '' AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//') AND regexp_matches(lower(line), {_q(W.AI_WORDS)}))
SELECT *, {_constants("PromptInjectionDetector", "Prompt Injection", "CRITICAL", "CWE-74", 0.95)} FROM ({_PROMPTS})""")
def det_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.prompt_lines(all_files(spark, sf_dir))


@query(f"""SELECT file_id, line_no AS line_number, operation, {_constants("OverprivilegedToolsDetector", "Over-Privileged AI Tool", "HIGH", "CWE-269", 0.90)}
FROM (SELECT *, bool_or(regexp_matches(lower(line), {_q(W.AGENT_WORDS)})) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {W.AGENT_LINES} PRECEDING AND CURRENT ROW) AS near FROM ({_SCRIPTS}))
JOIN (VALUES {", ".join(f"({_q(o)})" for o in W.OPERATIONS)}) v(operation) ON contains(lower(line), operation) WHERE near OR regexp_matches(line, {_q(W.TOOL_DEFINITION)})""")
def det_agent_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.agent_operations(all_files(spark, sf_dir))


_IS_SCRIPT = f"language IN {I.LANGUAGES}"
_COUNT = "length({0}) - length(replace({0}, '{1}', ''))"


def _grants(column: str, flags: str) -> str:
    return "[" + ", ".join(f"CASE WHEN regexp_matches({column}, {_q(f'(?{flags})' + p)}) THEN {_q(name)} END" for name, p in W.DANGERS) + "]"


def _permissions_sql(lines: str) -> str:
    return f"""WITH l AS (SELECT *, regexp_matches(line, {_q(W.CONFIG_OPENS)}) AS opens FROM {lines} WHERE {_IS_SCRIPT}),
g AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY file_id ORDER BY line_no) AS segment FROM l),
d AS (SELECT *, sum({_COUNT.format("line", "{")} - ({_COUNT.format("line", "}")})) OVER (PARTITION BY file_id, segment ORDER BY line_no) AS depth FROM g),
u AS (SELECT *, min(CASE WHEN NOT opens AND segment > 0 AND (depth <= 0 OR regexp_matches(line, '^\\s*def ')) THEN line_no END) OVER (PARTITION BY file_id, segment) AS until FROM d),
b AS (SELECT file_id, min(line_no) AS line_number, string_agg(line, chr(10) ORDER BY line_no) AS text FROM u WHERE segment > 0 AND line_no <= until GROUP BY file_id, segment),
h AS (SELECT file_id, line_number, array_to_string(list_filter({_grants("text", "is")}, lambda x: x IS NOT NULL), ', ') AS dangers FROM b),
o AS (SELECT file_id, line_no AS line_number, list_filter({_grants("line", "i")}, lambda x: x IS NOT NULL)[1] AS dangers FROM u WHERE segment = 0 OR line_no >= until)
SELECT file_id, line_number, dangers, {_constants("OverprivilegedToolsDetector", "Overly Permissive AI Config", "HIGH", "CWE-269", 0.90)} FROM h WHERE dangers <> ''
UNION ALL SELECT file_id, line_number, dangers, {_constants("OverprivilegedToolsDetector", "Dangerous Permission Setting", "HIGH", "CWE-269", 0.85)} FROM o WHERE dangers IS NOT NULL"""


def _prompt_flow_sql(lines: str) -> str:
    return f"""WITH l AS (SELECT *, nullif(regexp_extract(line, {_q(W.PROMPT_SOURCE)}, 1), '') AS taken FROM {lines} WHERE {_IS_SCRIPT}),
f AS (SELECT file_id, taken AS var, min(line_no) AS first FROM l WHERE taken IS NOT NULL GROUP BY 1, 2),
w AS (SELECT DISTINCT file_id, line_no, coalesce(taken, '') AS taken, unnest(regexp_extract_all(line, '(\\w+)', 1)) AS var FROM l WHERE regexp_matches(line, {_q(W.PROMPT_WORDS)}))
SELECT w.file_id, w.line_no AS line_number, arg_min(w.var, f.first) AS user_variable, {_constants("PromptInjectionDetector", "Prompt Injection", "CRITICAL", "CWE-74", 0.85)}
FROM w JOIN f ON f.file_id = w.file_id AND f.var = w.var AND f.first < w.line_no AND w.var <> w.taken GROUP BY 1, 2"""


_FILE_LINES = f"(SELECT file_id, language, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT *, string_split(code, chr(10)) AS p FROM {_ALL}))"


@query(_permissions_sql(_FILE_LINES))
def det_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.permission_configs(all_files(spark, sf_dir))


@query(_prompt_flow_sql(_FILE_LINES))
def det_prompt_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.prompt_flow(all_files(spark, sf_dir))


#: Lines of files made from orders and their line items; {a}: the quantity. Places are chosen by keys, so blocks open, restart, end early or never.
_PIECES = (
    'config = {"a": {a},', '"shell": True', '"tools": ["read", "delete"],', "}", "def run(x):", 'settings = {"exec": True, "n": {a}}', '["write",', '"delete"]', "q{a} = input()", 'prompt = f"{q1} {q2} {q3}"', "q{b} = request.form.get('x')",
    "chat(q{b}, q{a})", "# llm q2", "}}", 'permissions: {', '"unrestricted": True, "llm": q3',
)
_PIECE = f"replace(replace(list_extract([{', '.join(map(_q, _PIECES))}], CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber * l_quantity) % {len(_PIECES)} AS INTEGER) + 1), '{{a}}', CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR)), '{{b}}', CAST(l_linenumber AS VARCHAR))"
_MADE_LINES = f"(SELECT l_orderkey // 8 AS file_id, 'python' AS language, CAST(row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS line_no, {_PIECE} AS line FROM lineitem)"


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each eight orders, with a line of each line item."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("a"))
    place = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber") * F.col("a")) % len(_PIECES)).cast("int")
    piece = F.replace(F.replace(F.element_at(F.array(*map(F.lit, _PIECES)), place + 1), F.lit("{a}"), (F.col("a") % 5).cast("string")), F.lit("{b}"), F.col("l_linenumber").cast("string"))
    held = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a", piece.alias("line"))))
    code = F.array_join(F.transform(held, lambda x: x["line"]), "\n")
    return rows.groupBy(F.expr("l_orderkey div 8").alias("file_id")).agg(code.alias("code")).select("file_id", F.lit("made.py").alias("path"), F.lit("python").alias("language"), "code")


@query(_permissions_sql(_MADE_LINES))
def permissions_of_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration blocks in files made from line items."""
    return W.permission_configs(made_files(spark, sf_dir))


@query(_prompt_flow_sql(_MADE_LINES))
def prompt_flow_of_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over several lines in files made from line items."""
    return W.prompt_flow(made_files(spark, sf_dir))
