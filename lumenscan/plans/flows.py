"""Queries over flows: taint, sinks, reachability, enrichment, verdicts, and functions on source lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.text import is_code, lines, pat
from ..operators import scoped
from ..operators import taint as T
from .analytics import findings
from .scanning import _ALL, _documents_as_files, _q, all_files


_LINES = f"(SELECT file_id, path, language, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT *, string_split(code, chr(10)) AS p FROM {_ALL}))"


@query()
def taint_ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the taint graphs; files that are no Python, or don't parse, have none."""
    return T.graph(T.facts(all_files(spark, sf_dir)))[0]


@query()
def taint_ast_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graph(T.facts(all_files(spark, sf_dir)))[1]


@query()
def taint_attack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths from sources to sinks with their type and the trust ladder's status."""
    files = all_files(spark, sf_dir)
    paths = T.attack_paths(T.facts(files)).join(files.select("file_id", "code"), "file_id")
    reach = T.reach_status(F.col("vulnerability_type"), F.col("code"), F.col("source_line"), F.col("sink_line"))
    return paths.withColumn("r", reach).select("file_id", "source_name", "source_line", "sink_name", "sink_line", F.size("transforms").alias("n_transforms"), "vulnerability_type", "severity", "cwe_id", "r.status", F.array_join("r.sanitizers", ", ").alias("sanitizers"))


_REGISTRY = "(VALUES " + ", ".join(f"({k}, {_q(s[0])}, {_q(s[1])}, {_q(s[2])}, {_q(s[3])})" for k, s in enumerate(T.SINKS)) + ") r(ord, api, kind, cwe, sev)"
_CALLS = f"(SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'self.' WHEN 2 THEN 'my' ELSE 'x.y.' END || api || CASE WHEN page_id % 17 = 0 THEN '_' ELSE '' END AS call FROM pages JOIN {_REGISTRY} ON ord = page_id % {len(T.SINKS)})"


@query(f"SELECT page_id, call, coalesce(e.api, s.api) AS api, coalesce(e.kind, s.kind) AS vulnerability_type, coalesce(e.sev, s.sev) AS severity FROM {_CALLS} c LEFT JOIN {_REGISTRY.replace(' r(', ' e(')} ON lower(e.api) = lower(call) LEFT JOIN (SELECT page_id AS p, arg_min(api, ord) AS api, arg_min(kind, ord) AS kind, arg_min(sev, ord) AS sev FROM {_CALLS}, {_REGISTRY} WHERE ends_with(lower(call), lower(api)) GROUP BY 1) s ON s.p = page_id")
def sink_classify_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, one made for each page, by the sink registry: an exact name first, else the first name that is a suffix."""
    names = F.array(*(F.lit(s[0]) for s in T.SINKS))
    i = F.col("page_id") % 4
    head = F.when(i == 0, "").when(i == 1, "self.").when(i == 2, "my").otherwise("x.y.")
    call = F.concat(head, F.element_at(names, (F.col("page_id") % len(T.SINKS) + 1).cast("int")), F.when(F.col("page_id") % 17 == 0, "_").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", call.alias("call")).withColumn("i", T.sink_info(F.col("call"))).select("page_id", "call", "i.api", "i.vulnerability_type", "i.severity")


_KINDS = (*T.SANITISERS, "Unknown")
_MARK_ROWS = "(VALUES " + ", ".join(f"({_q(t)}, {_q(s)})" for t, all_ in T.SANITISERS.items() for s in all_) + ") m(kind, mark)"


@query(f"""WITH f AS (SELECT doc_id, text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'x = html.escape(y); urlparse(u)' WHEN 1 THEN 'cursor.execute(q, (a,))' WHEN 2 THEN 'v = os.environ["A"]' WHEN 3 THEN '{{{{ v | safe }}}}' ELSE 'run(c, shell=False)' END AS code,
  [{', '.join(map(_q, _KINDS))}][CAST(doc_id % {len(_KINDS)} AS INTEGER) + 1] AS kind FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, string_split(code, chr(10)) AS p FROM f), r AS (SELECT *, array_to_string(p[greatest(1, len(p) - 3):], chr(10)) AS region, p[len(p)] AS at_sink FROM l),
s AS (SELECT doc_id, mark FROM r JOIN {_MARK_ROWS} USING (kind) WHERE contains(lower(region), lower(mark)) UNION SELECT doc_id, 'parameterized_execute_args' FROM r WHERE kind = 'SQL Injection' AND regexp_matches(at_sink, {_q(T.PARAMETERS)})),
c AS (SELECT s.* FROM s JOIN r USING (doc_id) WHERE NOT (kind = 'XSS / Template Injection' AND regexp_matches(code, {_q(T.ANTI)})))
SELECT r.doc_id, kind, CASE WHEN x.marks IS NOT NULL THEN 'Reachability Eliminated' WHEN regexp_matches(region, {_q(T.RUNTIME)}) THEN 'Requires Manual Review' ELSE 'Confirmed Reachable' END AS status, coalesce(x.marks, '') AS sanitizers
FROM r LEFT JOIN (SELECT doc_id, string_agg(mark, ',' ORDER BY mark) AS marks FROM c GROUP BY 1) x ON x.doc_id = r.doc_id""")
def reach_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust ladder over every document, with one line of code added and a path over its last four lines."""
    i = F.col("doc_id") % 5
    tail = F.when(i == 0, "x = html.escape(y); urlparse(u)").when(i == 1, "cursor.execute(q, (a,))").when(i == 2, 'v = os.environ["A"]').when(i == 3, "{{ v | safe }}").otherwise("run(c, shell=False)")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    f = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat("text", F.lit("\n"), tail).alias("code"), kind.alias("kind")).withColumn("n", F.size(F.split("code", "\n", -1)))
    return f.withColumn("r", T.reach_status(F.col("kind"), F.col("code"), F.greatest(F.lit(1), F.col("n") - 3), F.col("n"))).select("doc_id", "kind", "r.status", F.array_join("r.sanitizers", ",").alias("sanitizers"))


@query()
def enrich_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of paths take findings of their scan, each once; the confirmed findings stand for the results."""
    f = findings(spark, sf_dir)
    key = F.xxhash64("ordinal", "severity", "line_number")
    results = f.filter("reach = 0").select(F.col("scan_id").alias("file_id"), key.alias("result_id"), F.col("line_number").alias("sink_line"), F.col("vulnerability_type").alias("type"), F.array(F.col("line_number") + 1, F.col("line_number") - 1).alias("lines"), (F.col("line_number") - 2).alias("source_line"))
    return T.enrich(f.filter("reach > 0").select(F.col("scan_id").alias("file_id"), key.alias("finding_id"), F.col("line_number").alias("line"), F.col("vulnerability_type").alias("type")), results)


# Output contexts, placeholders, validation words, entry points and routes.
OUTPUT = r"(?i)render_template|\.html|innerHTML|document\.write|Markup|\.safe|\|safe|Response\s*\(|make_response|escape\s*\(|html\.escape"
MARKERS = r"\?|%s|%\s*\(\s*\w+\s*\)\s*s|:\w+"
VALIDATION = r"(?i)\b(allowlist|whitelist|blacklist|sanitize|escape|validate|strip|isalnum|isalpha|isdigit|encode\s*\(|escape\s*\()"
ENTRY = r"""(?i)@\s*(app\.route|router\.(get|post|put|delete|patch)|api\.(get|post|put|delete|patch))\s*\(|if\s+__name__\s*==\s*["']__main__["']"""
WEB_IMPORT = r"(?m)^\s*(?:import|from)\s+(?i:flask|django|fastapi|starlette)(?:[\s.,]|$)"


# Statuses and reasons of the rules, in order.
VERDICTS = (
    ("Confirmed", "Verified attack path from source to sink; entry point and HTML/JS output context."),
    ("Out-of-scope", "No web framework in project and no routing decorators in file."),
    ("Out-of-scope", "Risk mitigated by parameterized query."),
    ("Out-of-scope", "Input validation or sanitization present on same line."),
    ("Confirmed", "Verified attack path from source to sink."),
    ("Unverified", "Static match only; no verified data flow."),
    ("Unverified", "Finding in non-production code."),
    ("Unverified", "No rule matched; default unverified."),
)


def verdict(kind: Column, line: Column, code: Column, path: Column, reach: Column, has_path: Column, is_web: Column, extra: Sequence[tuple[Column, str, str]] = ()) -> Column:
    """struct<status, reason>: the rules in order; Confirmed and Out-of-scope end it, of the others the last holds.

    extra: further rules (condition, status, reason), which stand behind the built-in ones. A condition that is null is not met."""
    k, line, reached = F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(line, F.lit("")), F.coalesce(reach == "Confirmed Reachable", F.lit(False))
    xss = F.contains(k, F.lit("xss")) | F.contains(k, F.lit("template injection"))
    entry, output = code.rlike(pat(ENTRY)), line.rlike(pat(OUTPUT)) | code.rlike(pat(OUTPUT))
    web = is_web | code.rlike(WEB_IMPORT)
    tests = F.contains(path, F.lit("/tests/")) | F.contains(path, F.lit("/examples/"))
    ending = [xss & reached & entry & output, xss & ~web & ~entry, F.contains(k, F.lit("sql injection")) & line.rlike(pat(MARKERS)), line.rlike(pat(VALIDATION)), reached]
    ladder = [(c, *v) for c, v in zip(ending, VERDICTS)]
    ladder += [r for r in extra if r[1] != "Unverified"] + [r for r in reversed(extra) if r[1] == "Unverified"]
    ladder += [(~has_path & (reach.isNull() | (reach == "Unverifiable")), *VERDICTS[5]), (tests, *VERDICTS[6])]
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    out = said(*VERDICTS[7])
    for condition, status, reason in reversed(ladder):
        out = F.when(condition, said(status, reason)).otherwise(out)
    return out


_VERDICT_KINDS = ("SQL Injection", "XSS", "Server-Side Template Injection", "Weak Hash")
_REACHES = ("Confirmed Reachable", "Reachability Eliminated", "Unverifiable", None)
_m = lambda c, p: f"regexp_matches({c}, {_q(p)})"


def _verdict_sql(first: str = "", last: str = "", n: str = "") -> str:
    """first: WHEN clauses behind the ending rules; last: those behind them; n: the places they give, from 9."""
    return f"""WITH f AS (SELECT file_id, code, CASE WHEN abs(file_id) % 6 = 0 THEN '/tests/' || path ELSE path END AS path, [{', '.join(map(_q, _VERDICT_KINDS))}][CAST(abs(file_id) % 4 AS INTEGER) + 1] AS kind,
  [{', '.join(_q(r) if r else 'NULL' for r in _REACHES)}][CAST(abs(file_id) // 4 % 4 AS INTEGER) + 1] AS reach, abs(file_id) % 3 = 0 AS has_path, abs(file_id) % 5 = 0 AS is_web, string_split(code, chr(10)) AS p FROM {_ALL} WHERE code IS NOT NULL AND path IS NOT NULL),
x AS (SELECT *, p[1 + CAST(abs(file_id) % len(p) AS INTEGER)] AS line FROM f),
c AS (SELECT file_id, CASE WHEN kind IN ('XSS', 'Server-Side Template Injection') AND reach = 'Confirmed Reachable' AND {_m('code', ENTRY)} AND ({_m('line', OUTPUT)} OR {_m('code', OUTPUT)}) THEN 1
  WHEN kind IN ('XSS', 'Server-Side Template Injection') AND NOT is_web AND NOT {_m('code', WEB_IMPORT)} AND NOT {_m('code', ENTRY)} THEN 2
  WHEN kind = 'SQL Injection' AND {_m('line', MARKERS)} THEN 3 WHEN {_m('line', VALIDATION)} THEN 4 WHEN reach = 'Confirmed Reachable' THEN 5 {first} {last}
  WHEN NOT has_path AND (reach IS NULL OR reach = 'Unverifiable') THEN 6 WHEN contains(path, '/tests/') THEN 7 ELSE 8 END AS n FROM x)
SELECT file_id, [{', '.join(_q(v[0]) for v in VERDICTS)}{n and ', ' + n.split('|')[0]}][n] AS status, [{', '.join(_q(v[1]) for v in VERDICTS)}{n and ', ' + n.split('|')[1]}][n] AS reason FROM c"""


def _verdicts(spark: SparkSession, sf_dir: str, extra: Sequence[tuple[Column, str, str]] = ()) -> DataFrame:
    i = F.abs("file_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    files = all_files(spark, sf_dir).filter("code is not null and path is not null")
    all_lines = F.split("code", "\n", -1)
    line = F.element_at(all_lines, (i % F.size(all_lines) + 1).cast("int"))
    path = F.when(i % 6 == 0, F.concat(F.lit("/tests/"), "path")).otherwise(F.col("path"))
    v = verdict(pick(_VERDICT_KINDS, i % 4), line, F.col("code"), path, pick(_REACHES, F.floor(i / 4) % 4), i % 3 == 0, i % 5 == 0, extra)
    return files.select("file_id", v.alias("v")).select("file_id", "v.*")


@query(_verdict_sql())
def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of one finding on a line of every file."""
    return _verdicts(spark, sf_dir)


@query(_verdict_sql("WHEN length(code) < 60 THEN 10", "WHEN abs(file_id) % 11 = 0 THEN 11 WHEN abs(file_id) % 2 = 0 THEN 9", "'Unverified', 'Out-of-scope', 'Unverified' | 'Even.', 'Short.', 'Eleventh.'"))
def verdict_with_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with three rules of a user's behind the built-in ones."""
    i = F.abs("file_id")
    own = ((i % 2 == 0, "Unverified", "Even."), (F.char_length("code") < 60, "Out-of-scope", "Short."), (i % 11 == 0, "Unverified", "Eleventh."))
    return _verdicts(spark, sf_dir, own)


@query(f"SELECT indent, count(*) AS n FROM (SELECT length(line) - length(ltrim(line, ' ' || chr(9))) AS indent FROM {_LINES}) GROUP BY 1")
def indent_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the width of what stands before their first other character."""
    return lines(all_files(spark, sf_dir)).groupBy((F.char_length("line") - F.char_length(F.ltrim("line", F.lit(" \t")))).cast("long").alias("indent")).agg(F.count(F.lit(1)).alias("n"))


_HANDLERS = f"""WITH r AS (SELECT *, regexp_matches(line, '@(?:app|blueprint)\\.route\\b') AS route, regexp_matches(line, '^\\s*def\\s+\\w+\\s*\\(') AS def, starts_with(ltrim(line, ' ' || chr(9)), '@') AS deco, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent, trim(line, ' ' || chr(9) || chr(13) || chr(12)) = '' AS blank FROM {_LINES}),
s AS (SELECT *, max(CASE WHEN route THEN line_no END) OVER w AS last_route, max(CASE WHEN NOT route AND NOT deco THEN line_no END) OVER w AS last_break FROM r WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT file_id, line_no, indent FROM s WHERE (def AND NOT route AND last_route > coalesce(last_break, 0)) OR regexp_matches(line, '^\\s*def\\s+do_(GET|POST|PUT|DELETE)\\s*\\('))
SELECT h.file_id, h.line_no AS start_line, CAST(coalesce((SELECT max(b.line_no) FROM r b WHERE b.file_id = h.file_id AND b.line_no > h.line_no AND NOT b.blank AND b.line_no < coalesce((SELECT min(e.line_no) FROM r e WHERE e.file_id = h.file_id AND e.line_no > h.line_no + 1 AND NOT e.blank AND e.indent <= h.indent), 1000000000)), h.line_no) AS INTEGER) AS end_line FROM h"""


@query(_HANDLERS)
def route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped.handlers(all_files(spark, sf_dir))


@query(f"SELECT file_id, line_no AS line_number, coalesce(CASE WHEN line_no - seed <= 3 THEN seed END, line_no) AS report_line FROM (SELECT *, max(CASE WHEN regexp_matches(line, 'random\\.seed\\s*\\(') THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS seed FROM {_LINES}) WHERE regexp_matches(line, '\\brandom\\.(?:choice|randint|random|shuffle)\\s*\\(')")
def seed_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random call up to three lines below a seed is reported at the seed."""
    rows = lines(all_files(spark, sf_dir).filter(F.contains("code", F.lit("random."))))
    seed = F.last(F.when(F.col("line").rlike(r"random\.seed\s*\("), F.col("line_no")), True).over(Window.partitionBy("file_id").orderBy("line_no"))
    found = rows.withColumn("seed", seed).filter(F.col("line").rlike(r"\brandom\.(?:choice|randint|random|shuffle)\s*\("))
    return found.select("file_id", F.col("line_no").alias("line_number"), F.coalesce(F.when(F.col("line_no") - F.col("seed") <= 3, F.col("seed")), "line_no").alias("report_line"))


@query(f"SELECT file_id, line_no, coalesce(nullif(regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1), ''), nullif(regexp_extract(line, 'function\\s+(\\w+)\\s*\\(', 1), ''), regexp_extract(line, '(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*=>', 1)) AS name FROM {_LINES} WHERE regexp_matches(line, '^\\s*(?:async\\s+)?def\\s+\\w+|function\\s+\\w+\\s*\\(|(?:const|let|var)\\s+\\w+\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*=>')")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    name = F.coalesce(got(r"^\s*(?:async\s+)?def\s+(\w+)"), got(r"function\s+(\w+)\s*\("), got(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"))
    return lines(all_files(spark, sf_dir)).select("file_id", "line_no", name.alias("name")).filter("name is not null")


_STRIP = "rtrim(regexp_replace({}, '#.*$', ''), ' ' || chr(9))"
_EDIT = "CASE page_id % 3 WHEN 0 THEN url || '  # note' WHEN 1 THEN url ELSE url || '/x' END"


@query(f"SELECT page_id, {_STRIP.format('url')} <> {_STRIP.format(_EDIT)} AS is_functional FROM pages")
def functional_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line differs from its original in more than a comment; the edits are made from each url."""
    i = F.col("page_id") % 3
    edited = F.when(i == 0, F.concat("url", F.lit("  # note"))).when(i == 1, F.col("url")).otherwise(F.concat("url", F.lit("/x")))
    code = lambda c: F.rtrim(F.regexp_replace(c, "#.*$", ""), F.lit(" \t"))
    return table(spark, sf_dir, "pages").select("page_id", (code(F.col("url")) != code(edited)).alias("is_functional"))


@query("SELECT c_custkey, regexp_replace(upper(c_name || '.' || c_mktsegment), '[^A-Z0-9_]', '_', 'g') AS env_name, sha256(from_base64(to_base64(encode(c_name)))::VARCHAR) AS round_trip FROM customer")
def env_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of environment variables, and a base64 round trip."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.upper(F.concat_ws(".", "c_name", "c_mktsegment")), "[^A-Z0-9_]", "_").alias("env_name"), F.sha2(F.decode(F.unbase64(F.base64(F.encode("c_name", "UTF-8"))), "UTF-8"), 256).alias("round_trip"))


_REPLY = "'**RISK:** ' || url || chr(10) || 'FIX: use ' || CAST(page_id AS VARCHAR) || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'SOURCE: doc-' || CAST(page_id % 50 AS VARCHAR) END || CASE WHEN page_id % 2 = 0 THEN chr(10) || '```' || chr(10) || 'x = 1' ELSE '' END"


@query(f"SELECT page_id, trim(regexp_extract(reply, 'RISK:[* ]*([^\\n]*)', 1)) AS risk, trim(regexp_extract(reply, 'FIX:[* ]*([^\\n]*)', 1)) AS fix, trim(regexp_extract(reply, 'SOURCE:[* ]*([^\\n]*)', 1)) AS source, CAST((length(reply) - length(replace(reply, '```', ''))) // 3 % 2 = 1 AS BOOLEAN) AS fence_closed FROM (SELECT page_id, {_REPLY} AS reply FROM pages)")
def reply_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a model's reply, one made of each page, and whether an odd code fence had to be closed."""
    i = F.col("page_id")
    tail = F.concat(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("SOURCE: doc-"), (i % 50).cast("string"))), F.when(i % 2 == 0, "\n```\nx = 1").otherwise(""))
    reply = F.concat(F.lit("**RISK:** "), "url", F.lit("\nFIX: use "), i.cast("string"), F.lit("\n"), tail)
    part = lambda name: F.trim(F.regexp_extract("reply", rf"{name}:[* ]*([^\n]*)", 1)).alias(name.lower())
    fences = F.regexp_count("reply", F.lit("```"))
    return table(spark, sf_dir, "pages").select("page_id", reply.alias("reply")).select("page_id", part("RISK"), part("FIX"), part("SOURCE"), (fences % 2 == 1).alias("fence_closed"))


@query(f"""SELECT d.file_id, d.line_no FROM (SELECT file_id, path, line_no FROM {_LINES} WHERE line_no <= 40 AND path IS NOT NULL) d WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE 'repo/' || source END AS path, CAST(1 + doc_id % 9 AS INTEGER) AS line_no FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL) c
  WHERE c.line_no = d.line_no AND c.path = d.path) OR (NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 3 = 0 AND e.doc_id % 2 = 0 AND e.source = d.path) AND EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 3 = 0 AND e.doc_id % 2 = 1 AND e.source = d.path AND 1 + e.doc_id % 9 = d.line_no))""".replace("line_no <= 40 AND ", ""))
def diff_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within the changed ones of their path, else within those of a path with the same base name. Two equi-joins, no search."""
    changed = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0 and source is not null").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("repo/"), "source")).alias("path"), (F.col("doc_id") % 9 + 1).cast("int").alias("line_no")).distinct()
    rows = lines(all_files(spark, sf_dir)).filter("path is not null").select("file_id", "path", "line_no")
    known = changed.select("path").distinct().withColumn("known", F.lit(True))
    exact = rows.join(changed, ["path", "line_no"], "left_semi").select("file_id", "line_no")
    base = lambda c: F.substring_index(c, "/", -1)
    by_base = changed.filter(F.contains("path", F.lit("/"))).select(base(F.col("path")).alias("base"), "line_no").distinct()
    rest = rows.join(known, "path", "left_anti").withColumn("base", base(F.col("path"))).join(by_base, ["base", "line_no"], "left_semi").select("file_id", "line_no")
    return exact.union(rest)


__all__ = ["all_files", "is_code", "verdict"]
