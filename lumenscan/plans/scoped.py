"""Queries over whole-file findings, with their SQL: taint by a recursive query, regions by window frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import query
from ..operators import scoped as S
from ..operators.detectors import ASSIGN, SWEEPS
from ..operators.injection import LANGUAGES
from ..operators.web import OPERATIONS
from .flows import _ALL, _HANDLERS, _LINES, all_files
from .scanning import _q
from .web import _constants

_CODE = "trim(line, ' ' || chr(9) || chr(13) || chr(12)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9)), '#')"
_PYTHON = "language = 'python'"


def _has(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _seed(pattern: str) -> str:
    return f"SELECT file_id, regexp_extract(line, {_q(pattern)}, 1) AS var FROM l WHERE {_has(pattern)}"


def _parameters(pattern: str) -> str:
    return f"SELECT file_id, var FROM (SELECT file_id, trim(split_part(split_part(trim(unnest(string_split(regexp_extract(line, {_q(pattern)}, 1), ','))), ':', 1), '=', 1)) AS var FROM l WHERE {_has(pattern)}) WHERE regexp_full_match(var, '\\w+') AND var <> 'self'"


def _closure(seeds: str, gate: str, before: int = 0, after: int = 0) -> str:
    """l: lines with the text of their region, t: tainted variables, w: words of lines."""
    return f"""WITH RECURSIVE l AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS region FROM {_LINES} WHERE {gate}),
e AS (SELECT file_id, line_no, regexp_extract(line, {_q(ASSIGN)}, 1) AS target, unnest(list_distinct(regexp_extract_all(regexp_extract(line, {_q(ASSIGN)}, 2), '(\\w+)', 1))) AS word FROM l WHERE {_has(ASSIGN)}),
s(file_id, var, pos, sweep) AS (SELECT DISTINCT file_id, var, 0, 1 FROM ({seeds}) UNION SELECT e.file_id, e.target, e.line_no, s.sweep + CAST(e.line_no <= s.pos AS INTEGER) FROM s JOIN e ON e.file_id = s.file_id AND e.word = s.var WHERE s.sweep + CAST(e.line_no <= s.pos AS INTEGER) <= {SWEEPS}),
t AS (SELECT DISTINCT file_id, var FROM s),
w AS (SELECT file_id, line_no, unnest(list_distinct(regexp_extract_all(line, '(\\w+)', 1))) AS var FROM l)"""


_ON_LINE = "JOIN w ON w.file_id = l.file_id AND w.line_no = l.line_no JOIN t ON t.file_id = l.file_id AND t.var = w.var"


@query(f"""{_closure(_seed(S.LOG_SOURCE) + " UNION " + _parameters(S.METHOD_PARAMETERS), "true", 9, 0)}
SELECT l.file_id, l.line_no AS line_number, {_constants("LogInjectionDetector", "Log Injection", "MEDIUM", "CWE-117", 0.85)}, min(w.var) AS tainted_var FROM l {_ON_LINE}
WHERE {_CODE} AND ({_has(S.LOG_SINK)} OR ({_has(S.LOG_WRITE)} AND {_has("(?i)log", "region")})) AND NOT regexp_matches(line, w.var || {_q(S.LOG_CLEANED)}) GROUP BY 1, 2""")
def det_log_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log_injection(all_files(spark, sf_dir))


@query(f"""{_closure(" UNION ".join(map(_seed, S.PAGE_SOURCES)), f"language IN {LANGUAGES}", 3, 4)}
SELECT l.file_id, l.line_no AS line_number, {_constants("XSSDetector", "Reflected XSS", "HIGH", "CWE-79", 0.88)}, min(w.var) AS user_var FROM l {_ON_LINE}
WHERE {_has(S.PAGE_SINK)} AND (NOT {_has(S.PAGE_RETURN)} OR {_has(S.PAGE_TAG)}) AND NOT regexp_matches(region, {_q(S.PAGE_ESCAPED)} || w.var)
AND EXISTS (SELECT 1 FROM ({_HANDLERS}) h WHERE h.file_id = l.file_id AND l.line_no BETWEEN h.start_line AND h.end_line) GROUP BY 1, 2""")
def det_xss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cross_site_scripting(all_files(spark, sf_dir))


@query(f"""{_closure(_seed(S.WEB_SOURCE), _PYTHON, 7, 2)}
SELECT file_id, line_no AS line_number, {_constants("OperationalSecurityDetector", "Open Redirect", "HIGH", "CWE-601", 0.90)} FROM l WHERE {_has(S.REDIRECT)} AND NOT {_has(S.REDIRECT_SAFE, "region")}
AND ({_has(S.REDIRECT_INPUT, "region")} OR EXISTS (SELECT 1 FROM w JOIN t ON t.file_id = w.file_id AND t.var = w.var WHERE w.file_id = l.file_id AND w.line_no BETWEEN l.line_no - 7 AND l.line_no + 2))""")
def det_open_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.open_redirects(all_files(spark, sf_dir))


@query(f"""{_closure(_seed(S.WEB_SOURCE), _PYTHON, 5, 1)}, p AS (SELECT * FROM t UNION {_parameters(S.PARAMETERS)})
SELECT file_id, line_no AS line_number, {_constants("OperationalSecurityDetector", "Memory Exhaustion", "HIGH", "CWE-400", 0.91)} FROM l WHERE {_CODE} AND {_has(S.ALLOCATION)} AND NOT {_has(S.BOUNDED, "region")}
AND (contains(line, 'request') OR EXISTS (SELECT 1 FROM w JOIN p ON p.file_id = w.file_id AND p.var = w.var WHERE w.file_id = l.file_id AND w.line_no = l.line_no))""")
def det_memory_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.memory_exhaustion(all_files(spark, sf_dir))


def _template(pattern: str) -> str:
    return f"EXISTS (SELECT 1 FROM t WHERE t.file_id = l.file_id AND t.var = regexp_extract(line, {_q(pattern)}, 1))"


@query(f"""{_closure(_seed(S.WEB_SOURCE), _PYTHON)}, k AS (SELECT file_id, line_no AS line_number, CASE WHEN {_template(S.FORMAT_CALL)} THEN 'tainted_format_template' WHEN {_has(S.FORMAT_INLINE)} THEN 'request_template_format' WHEN {_template(S.FORMAT_PERCENT)} THEN 'tainted_percent_template' END AS pattern FROM l WHERE {_CODE})
SELECT file_id, line_number, 'OperationalSecurityDetector' AS detector_name, 'Format String Injection' AS vulnerability_type, 'MEDIUM' AS severity, 'CWE-134' AS cwe_id, CAST(CASE pattern WHEN 'request_template_format' THEN 0.89 ELSE 0.86 END AS DOUBLE) AS confidence, pattern FROM k WHERE pattern IS NOT NULL""")
def det_format_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.format_strings(all_files(spark, sf_dir))


def _names(pattern: str) -> str:
    return f"SELECT file_id, unnest(regexp_extract_all(trim(line, ' ' || chr(9) || chr(13) || chr(12)), {_q(pattern)}, 1)) AS name FROM l"


@query(f"""WITH l AS (SELECT * FROM {_LINES}), x AS (SELECT DISTINCT file_id FROM l WHERE {_has(S.XML_MODULES)}),
trusted AS (SELECT DISTINCT * FROM ({_names(S.SAFE_MODULE_ALIAS)})),
a AS (SELECT DISTINCT * FROM ({_names(S.XML_MODULE_ALIAS)} UNION {_names(S.XML_NAME_ALIAS)} WHERE {_has(S.XML_MODULES)}) EXCEPT ({" UNION ".join(map(_names, S.SAFE_NAMES))})),
c AS (SELECT * FROM l SEMI JOIN x ON x.file_id = l.file_id WHERE {_CODE} AND NOT {_has(S.XML_SAFE)} AND NOT EXISTS (SELECT 1 FROM trusted r WHERE r.file_id = l.file_id AND regexp_matches(l.line, '\\b' || r.name || '\\.'))),
k AS (SELECT file_id, line_no, 'explicit_enabler' AS detection_type FROM c WHERE {_has(S.XML_ENABLERS)} UNION ALL SELECT file_id, line_no, CASE WHEN {_has(S.XML_CALLS)} THEN 'unsafe_xml_call'
  WHEN EXISTS (SELECT 1 FROM a WHERE a.file_id = c.file_id AND regexp_matches(c.line, '\\b' || a.name || '\\.(?:{S.XML_FUNCTIONS})\\s*\\(')) THEN 'alias_xml_call'
  WHEN EXISTS (SELECT 1 FROM a WHERE a.file_id = c.file_id AND regexp_matches(c.line, '(?:^|[^\\w])' || a.name || '\\s*\\(')) THEN 'alias_func_call' END FROM c)
SELECT file_id, line_no AS line_number, 'XXEDetector' AS detector_name, 'XML External Entity (XXE)' AS vulnerability_type, CASE detection_type WHEN 'explicit_enabler' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'CWE-611' AS cwe_id,
  CAST(CASE detection_type WHEN 'explicit_enabler' THEN 0.97 ELSE 0.88 END AS DOUBLE) AS confidence, detection_type FROM k WHERE detection_type IS NOT NULL""")
def det_xxe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.xml_entities(all_files(spark, sf_dir))


@query(f"""WITH l AS (SELECT * FROM {_LINES} WHERE {_PYTHON}), g AS (SELECT file_id, line_no, coalesce(nullif(regexp_extract(line, {_q(S.DOTS_GUARD[0])}, 1), ''), regexp_extract(line, {_q(S.DOTS_GUARD[1])}, 1)) AS var FROM l WHERE {_has(S.DOTS_GUARD[0])} OR {_has(S.DOTS_GUARD[1])})
SELECT g.file_id, min(l.line_no) FILTER (regexp_matches(l.line, '\\b(?:open|os\\.path\\.join)\\s*\\(.*\\b' || g.var || '\\b')) AS line_number, {_constants(S.EVASION, "Path Traversal", "HIGH", "CWE-22", 0.93)}, g.var AS path_var
FROM g JOIN l ON l.file_id = g.file_id AND l.line_no BETWEEN g.line_no AND g.line_no + {S.DOTS_LINES - 1} GROUP BY g.file_id, g.line_no, g.var HAVING NOT bool_or({_has(S.DOTS_DECODED)}) AND bool_or(regexp_matches(l.line, '\\b(?:open|os\\.path\\.join)\\s*\\(.*\\b' || g.var || '\\b'))""")
def det_encoded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.encoded_paths(all_files(spark, sf_dir))


@query(f"""WITH l AS (SELECT * FROM {_LINES} WHERE {_PYTHON}), g AS (SELECT file_id, line_no, regexp_extract(line, {_q(S.QUOTED)}, 1) AS var FROM l WHERE {_has(S.QUOTED)})
SELECT g.file_id, min(l.line_no) AS line_number, {_constants(S.EVASION, "Command Injection", "CRITICAL", "CWE-78", 0.95)}, g.var AS quoted_var FROM g JOIN l ON l.file_id = g.file_id AND l.line_no BETWEEN g.line_no AND g.line_no + {S.QUOTED_LINES - 1}
WHERE regexp_matches(l.line, '\\bos\\.system\\s*\\(.*\\b' || g.var || '\\b') OR ({_has(S.SHELL_CALL)} AND contains(l.line, 'shell=True') AND regexp_matches(l.line, '\\b' || g.var || '\\b')) GROUP BY g.file_id, g.line_no, g.var""")
def det_quoted_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quoted_shells(all_files(spark, sf_dir))


@query()
def det_signed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL, as syntax trees decide."""
    return S.signed_loads(all_files(spark, sf_dir))


_PAIRS = " AND ".join(f"length(replace(code, {_q(a)}, '')) = length(replace(code, {_q(b)}, ''))" for a, b in ("()", "[]", "{}"))
_UNQUOTED = f"""regexp_replace(line, {_q(r'"[^"]*"|' + "'[^']*'")}, '""', 'g')"""
_LOAD = r"(?:^|[^\w.])(?:" + "|".join(c.replace(".", r"\.") for c in S.UNSAFE_LOADS) + r")\s*\("
_TEST = r"^(?:if|elif)\b(.*?):(?:\s|$)"
#: Signed loads by the layout of lines, for SQL that has no syntax trees: an `if` or `elif` whose test names a signature (names that are
#: called with their dots, others without) holds the lines below it that are indented more, and those of its `elif`s and `else`. The
#: least indented line with a load is the nearest to the test. Files whose brackets don't pair don't parse. Holds for files with one
#: statement a line and texts that end on their line, as the snippets are.
SIGNED_LOADS_SQL = f"""WITH l AS (SELECT file_id, line_no, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent, ltrim(split_part({_UNQUOTED}, '#', 1), ' ' || chr(9)) AS s FROM {_LINES} SEMI JOIN (SELECT file_id FROM {_ALL} WHERE {_PYTHON} AND {_PAIRS}) USING (file_id) WHERE {_PYTHON} AND {_CODE}),
t AS (SELECT file_id, line_no, indent, regexp_replace(regexp_extract(s, {_q(_TEST)}, 1), '\\b[A-Za-z_]\\w*\\s*=([^=])', '\\1', 'g') AS test FROM l WHERE {_has(_TEST, "s")}),
h AS (SELECT *, list_concat(regexp_extract_all(test, '([A-Za-z_][\\w.]*)\\s*\\(', 1), regexp_extract_all(test, '(?:^|[^\\w.])([A-Za-z_]\\w*)', 1)) AS named FROM t),
e AS (SELECT h.file_id, h.line_no, min(l.line_no) AS ends FROM h JOIN l ON l.file_id = h.file_id AND l.line_no > h.line_no AND (l.indent < h.indent OR (l.indent = h.indent AND NOT {_has(r"^(?:elif|else)\b", "l.s")})) GROUP BY 1, 2)
SELECT h.file_id, CAST(arg_min(l.line_no, l.indent * 1000000 + l.line_no) AS INTEGER) AS line_number, {_constants(S.EVASION, "Unsafe Deserialization", "CRITICAL", "CWE-502", 0.96)} FROM h LEFT JOIN e ON e.file_id = h.file_id AND e.line_no = h.line_no
JOIN l ON l.file_id = h.file_id AND l.line_no >= h.line_no AND l.line_no < coalesce(e.ends, 1000000) AND {_has(_LOAD, "l.s")} WHERE {_has("|".join(S.SIGNATURE_WORDS), "lower(array_to_string(h.named, ' '))")} GROUP BY h.file_id, h.line_no"""


@query(f"""{_closure(_seed(S.SQL_SOURCE), _PYTHON, S.SQL_BEFORE, S.SQL_AFTER)},
k AS (SELECT file_id, line_no, {_has(S.SQL_INLINE)} AS inlined, nullif(regexp_extract(line, {_q(S.SQL_VARIABLE)}, 1), '') AS var, region FROM l WHERE {_CODE} AND {_has(S.SQL_CALL)} AND NOT {_has(S.SQL_PARAMETERS)})
SELECT file_id, line_no AS line_number, 'SQLInjectionDetector' AS detector_name, 'SQL Injection' AS vulnerability_type, 'CRITICAL' AS severity, 'CWE-89' AS cwe_id, CAST(CASE WHEN inlined THEN 0.92 ELSE 0.88 END AS DOUBLE) AS confidence, CASE WHEN NOT inlined THEN var END AS sql_var
FROM k WHERE inlined OR (var IS NOT NULL AND ({_has(S.SQL_BUILT[0], "region")} OR {_has(S.SQL_BUILT[1], "region")} OR EXISTS (SELECT 1 FROM t WHERE t.file_id = k.file_id AND t.var = k.var)))""")
def det_sql_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql_injection(all_files(spark, sf_dir))


_BREAKS = "list_transform({}, lambda x: len(x) - len(replace(x, chr(10), '')))"


@query(f"""WITH f AS (SELECT file_id, {_BREAKS.format(f"string_split_regex(code, {_q(S.TOOL_LIST)})")} AS gaps, {_BREAKS.format(f"regexp_extract_all(code, {_q(S.TOOL_LIST)})")} AS own, regexp_extract_all(code, {_q(S.TOOL_LIST)}, 1) AS held FROM {_ALL} WHERE language IN {LANGUAGES} AND regexp_matches(code, {_q(S.TOOL_LIST)})),
h AS (SELECT file_id, gaps, own, unnest(held) AS content, generate_subscripts(held, 1) AS k FROM f),
o AS (SELECT file_id, k, 1 + list_sum(gaps[1:k]) + coalesce(list_sum(own[1:k - 1]), 0) AS line_number, list_sort(list_filter([{", ".join(map(_q, OPERATIONS))}], lambda x: contains(lower(content), x))) AS found FROM h)
SELECT file_id, CAST(line_number AS INTEGER) AS line_number, CAST(len(found) AS INTEGER) AS n_operations, array_to_string(found, ', ') AS operations, {_constants("OverprivilegedToolsDetector", "Over-Privileged AI Agent", "HIGH", "CWE-269", 0.95)} FROM o WHERE len(found) > 0""")
def det_tool_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tool_lists(all_files(spark, sf_dir))
