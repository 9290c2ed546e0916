"""Queries over source files: scans, lines, detectors, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import query, table
from ..functions.text import html_escape, is_code, lines, pat, snippet
from ..operators import detectors as D
from ..operators import injection as I
from ..sources.corpus import code_files, code_files_sql

_ALL = f"(SELECT doc_id AS file_id, source AS path, lang AS language, text AS code FROM documents UNION ALL SELECT -file_id, path, language, code FROM ({code_files_sql()}))"
_FILES = f"SELECT * FROM {_ALL}"
_LINES = f"SELECT file_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT file_id, string_split(code, chr(10)) AS p FROM ({_FILES}))"


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), F.col("lang").alias("language"), F.col("text").alias("code"))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files, then the snippets, whose ids are negative."""
    return _documents_as_files(spark, sf_dir).unionByName(code_files(spark).withColumn("file_id", -F.col("file_id")))


_DOCS = "SELECT doc_id AS file_id, source AS path, lang AS language, text AS code FROM documents"


@query("SELECT doc_id, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS file_size_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM documents")
def scan_files_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, size and line count of every file."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size_bytes"), F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 10485760 THEN 'too large' ELSE NULL END AS validation_error FROM documents")
def scan_validate_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNull(), "unreadable").when(n == 0, "empty").when(n > 10 * 1024 * 1024, "too large").alias("validation_error"))


_EXT = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin"}


@query(f"SELECT file_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _EXT.items())} END AS by_extension FROM ({_FILES})")
def scan_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in _EXT.items() for x in pair))
    return all_files(spark, sf_dir).select("file_id", F.try_element_at(names, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).alias("by_extension"))


_EXCLUDED = ("__pycache__", ".git", "node_modules", "venv", ".env")


@query(f"SELECT page_id, url FROM pages WHERE NOT ({' OR '.join(f'contains(url, {x!r})' for x in _EXCLUDED)})")
def scan_exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.lit(True)
    for x in _EXCLUDED:
        keep &= ~F.contains("url", F.lit(x))
    return table(spark, sf_dir, "pages").filter(keep).select("page_id", "url")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def scan_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query(_LINES)
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(all_files(spark, sf_dir)).select("file_id", "line_no", "line")


@query("SELECT doc_id AS file_id, count(*) AS n_lines, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') AS n_filled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(_documents_as_files(spark, sf_dir))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.btrim("line", F.lit(" \t\r")) != "").alias("n_filled"))


@query(f"SELECT file_id, line_no AS line_number, string_agg(printf('%3d| %s', line_no, line), chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS code_snippet FROM ({_LINES})")
def line_snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(all_files(spark, sf_dir)).select("file_id", F.col("line_no").alias("line_number"), snippet(2).alias("code_snippet"))


@query(f"SELECT file_id, line_no FROM ({_LINES}) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(12)) <> '' AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//')")
def comment_blank_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(all_files(spark, sf_dir)).filter(is_code(F.col("line"), slashes=True)).select("file_id", "line_no")


@query("SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS base_name, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("base_name"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_hash FROM pages")
def html_escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(html_escape(F.col("html")), 256).alias("escaped_hash"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _register_detectors() -> None:
    names = {"det_hardcoded_secret": D.SECRETS, "det_weak_random": D.WEAK_RANDOM, "det_weak_hash": D.WEAK_HASH, "det_sql_fstring": D.SQL_FSTRING, "det_deserialization": D.DESERIALIZATION, "det_reflection": D.REFLECTION, "det_crypto": D.CRYPTO, "det_temp_file": D.TEMP_FILE, "det_memory": D.MEMORY, "det_type_confusion": D.TYPE_CONFUSION, "det_ops_debug": D.DEBUG}
    for name, detector in names.items():

        def run(spark: SparkSession, sf_dir: str, detector=detector) -> DataFrame:
            return D.detect(all_files(spark, sf_dir), detector)

        run.__name__ = name
        query(D.detect_sql(_FILES, detector))(run)


_register_detectors()

_SEED_LINES = ("random.seed(time.time())", "a = random.choice(rows)", "x = 1", "", "random.seed(7); random.random()", "# random.seed(os.getpid())", "random.shuffle(deck)", "random.seed(int(t))", "game = 1", "b = random.randint(1, 6)", "y = 2", "  // random.random()", "session = 1", "c = secrets.choice(random.random())", "z = 3", "w = 4", "random.random(random.seed(str(now)))")
_SEED_FILES = f"""SELECT l_suppkey AS file_id, string_agg(line, chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, line) AS code
FROM (SELECT *, list_extract({list(_SEED_LINES)}, CAST((l_partkey + l_orderkey) % {len(_SEED_LINES)} AS INTEGER) + 1) AS line FROM lineitem) GROUP BY 1"""


@query(D.detect_sql(_SEED_FILES, D.WEAK_RANDOM))
def weak_random_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, calls below them and words around them, over a file per supplier with a line for each of its line items."""
    line = F.element_at(F.array(*map(F.lit, _SEED_LINES)), ((F.col("l_partkey") + F.col("l_orderkey")) % len(_SEED_LINES) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", line.alias("line")))).alias("rows"))
    files = rows.select("file_id", F.lit("a.py").alias("path"), F.lit("python").alias("language"), F.array_join("rows.line", "\n").alias("code"))
    return D.detect(files, D.WEAK_RANDOM)


_ALL_SQL = " UNION ALL ".join(f"SELECT *, {k} AS det_ord FROM ({D.detect_sql(_FILES, d)})" for k, d in enumerate(D.ALL))
_OWNER_SQL = "CASE lower(vulnerability_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D._OWNERS.items()) + " END"
_KEY_SQL = "CASE lower(vulnerability_type) WHEN 'attribute injection' THEN 'mass assignment' ELSE lower(vulnerability_type) END"


@query(f"SELECT file_id, line_number, detector_name, vulnerability_type, severity, cwe_id, confidence, CAST(det_ord AS INTEGER) AS det_ord FROM ({_ALL_SQL})")
def det_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_all(all_files(spark, sf_dir))


@query(f"SELECT file_id, line_number, detector_name, vulnerability_type, severity, cwe_id, confidence, CAST(det_ord AS INTEGER) AS det_ord FROM ({_ALL_SQL}) QUALIFY row_number() OVER (PARTITION BY file_id, line_number, {_KEY_SQL} ORDER BY coalesce({_OWNER_SQL} = detector_name, false) DESC, confidence DESC, det_ord) = 1")
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup(D.detect_all(all_files(spark, sf_dir)))


@query(f"SELECT severity, count(*) AS n FROM ({D.detect_sql(_DOCS, D.SECRETS)}) GROUP BY severity")
def det_secrets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in all documents by severity."""
    return D.detect(_documents_as_files(spark, sf_dir), D.SECRETS).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_CODE_LINES = f"SELECT * FROM ({_LINES}) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(12)) <> '' AND NOT starts_with(trim(line), '#')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""WITH e AS (SELECT file_id, line_no, regexp_extract(line, {_q(D.CHECK_CALL)}, 1) AS var, 'check' AS kind FROM ({_CODE_LINES}) WHERE regexp_matches(line, {_q(D.CHECK_CALL)})
  UNION ALL SELECT file_id, line_no, regexp_extract(line, {_q(D.USE_CALL)}, 1), 'use' FROM ({_CODE_LINES}) WHERE regexp_matches(line, {_q(D.USE_CALL)}))
SELECT u.file_id, u.line_no AS line_number, u.var, max(c.line_no) AS check_line FROM e u JOIN e c ON c.file_id = u.file_id AND c.var = u.var AND c.kind = 'check' AND c.line_no < u.line_no WHERE u.kind = 'use' GROUP BY 1, 2, 3""")
def det_toctou_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.toctou(all_files(spark, sf_dir))


@query(f"""WITH RECURSIVE l AS ({_CODE_LINES}),
e AS (SELECT file_id, line_no, regexp_extract(line, {_q(D.ASSIGN)}, 1) AS target, unnest(list_distinct(regexp_extract_all(regexp_extract(line, {_q(D.ASSIGN)}, 2), '(\\w+)', 1))) AS word FROM l WHERE regexp_matches(line, {_q(D.ASSIGN)})),
s(file_id, var, pos, sweep) AS (SELECT DISTINCT file_id, regexp_extract(line, {_q(D.SOURCE)}, 1), 0, 1 FROM l WHERE regexp_matches(line, {_q(D.SOURCE)})
  UNION SELECT e.file_id, e.target, e.line_no, s.sweep + CAST(e.line_no <= s.pos AS INTEGER) FROM s JOIN e ON e.file_id = s.file_id AND e.word = s.var WHERE s.sweep + CAST(e.line_no <= s.pos AS INTEGER) <= {D.SWEEPS})
SELECT DISTINCT file_id, var FROM s""")
def taint_regex_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tainted_variables(all_files(spark, sf_dir))


def _near_taint_sql(sink: I.Sink) -> str:
    """The same closure by a recursive query, then the frame by a range condition."""
    return f"""WITH RECURSIVE l AS (SELECT * FROM ({_LINES}) WHERE file_id IN (SELECT file_id FROM ({_FILES}) WHERE language IN {I.LANGUAGES})),
e AS (SELECT file_id, line_no, regexp_extract(line, {_q(D.ASSIGN)}, 1) AS target, unnest(list_distinct(regexp_extract_all(regexp_extract(line, {_q(D.ASSIGN)}, 2), '(\\w+)', 1))) AS word FROM l WHERE regexp_matches(line, {_q(D.ASSIGN)})),
s(file_id, var, pos, sweep) AS (SELECT DISTINCT file_id, regexp_extract(line, {_q(I.SOURCE)}, 1), 0, 1 FROM l WHERE regexp_matches(line, {_q(I.SOURCE)})
  UNION SELECT e.file_id, e.target, e.line_no, s.sweep + CAST(e.line_no <= s.pos AS INTEGER) FROM s JOIN e ON e.file_id = s.file_id AND e.word = s.var WHERE s.sweep + CAST(e.line_no <= s.pos AS INTEGER) <= {D.SWEEPS}),
w AS (SELECT file_id, line_no, unnest(regexp_extract_all(line, '(\\w+)', 1)) AS var FROM l)
SELECT l.file_id, l.line_no AS line_number, {_q(sink.name)} AS detector_name, {_q(sink.vulnerability_type)} AS vulnerability_type, {_q(sink.severity)} AS severity, {_q(sink.cwe_id)} AS cwe_id,
  CAST({sink.confidence} AS DOUBLE) AS confidence, min(w.var) AS tainted_var
FROM l JOIN w ON w.file_id = l.file_id AND w.line_no BETWEEN l.line_no - {sink.before} AND l.line_no + {sink.after} JOIN (SELECT DISTINCT file_id, var FROM s) t ON t.file_id = w.file_id AND t.var = w.var
WHERE regexp_matches(l.line, {_q(sink.pattern)}) AND trim(l.line, ' ' || chr(9) || chr(13) || chr(12)) <> '' AND NOT starts_with(trim(l.line), '#') GROUP BY 1, 2"""


@query(_near_taint_sql(I.XPATH))
def det_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.near_taint(all_files(spark, sf_dir), I.XPATH)


@query(_near_taint_sql(I.LDAP))
def det_ldap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.near_taint(all_files(spark, sf_dir), I.LDAP)


@query(f"""WITH l AS ({_LINES}), c AS (SELECT *, sum(d) OVER (PARTITION BY file_id ORDER BY line_no) AS depth FROM (SELECT *, length(replace(line, ')', '')) - length(replace(line, '(', '')) AS d FROM l)),
k AS (SELECT a.file_id, a.line_no, coalesce((SELECT min(b.line_no) FROM c b WHERE b.file_id = a.file_id AND b.line_no >= a.line_no AND b.depth <= a.depth - a.d), 1000000) AS until FROM c a WHERE contains(a.line, 'set_cookie')),
o AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k e WHERE e.file_id = k.file_id AND e.line_no < k.line_no AND e.until >= k.line_no))
SELECT o.file_id, o.line_no AS line_number, 'SecureCookieDetector' AS detector_name, 'Insecure Cookie' AS vulnerability_type, 'HIGH' AS severity, 'CWE-614' AS cwe_id, CAST(0.95 AS DOUBLE) AS confidence
FROM o JOIN l ON l.file_id = o.file_id AND l.line_no BETWEEN o.line_no AND o.until GROUP BY 1, 2 HAVING regexp_matches(string_agg(l.line, chr(10) ORDER BY l.line_no), {_q(I.INSECURE)})""")
def det_cookie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.insecure_cookies(all_files(spark, sf_dir))


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text. Five inner words in a row of an item stand in the same row in any such document:
    an equi-join on their hash finds the pairs, which are then compared as texts. Items of fewer than seven words, if there
    are any, are compared with every document."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part"))
    row_of = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, 5), " "))
    words = F.split("part", " ", -1)
    long_items = b.filter(F.size(words) >= 7).select("item_id", row_of(words, 2).alias("key"))
    rows = d.select("doc_id", F.split("text", " ", -1).alias("w")).filter(F.size("w") >= 5)
    keys = rows.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda k: row_of("w", k)))).alias("key"))
    pairs = keys.join(long_items, "key").select("doc_id", "item_id").distinct()
    found = pairs.join(d, "doc_id").join(b, "item_id").filter(F.contains("text", F.col("part"))).select("doc_id", "item_id")
    return found.union(d.join(b.filter(F.size(words) < 7), F.contains("text", F.col("part"))).select("doc_id", "item_id"))


_EDGES = [(1, "a", "b"), (1, "b", "c"), (2, "a", "b"), (2, "a", "c"), (2, "b", "d"), (2, "c", "d"), (3, "a", "b"), (3, "b", "a"), (3, "b", "c"), *((4, f"n{k}", f"n{k + 1}") for k in range(15)), *((5, f"n{k}", f"n{k + 1}") for k in range(16))]
_ENDS = {1: ("a", "c"), 2: ("a", "d"), 3: ("a", "c"), 4: ("n0", "n15"), 5: ("n0", "n16")}
_EDGE_ROWS = "VALUES " + ", ".join(f"({g}, '{a}', '{b}')" for g, a, b in _EDGES)
_END_ROWS = "VALUES " + ", ".join(f"({g}, '{a}', '{b}')" for g, (a, b) in _ENDS.items())


@query(f"""WITH RECURSIVE e(g, src, dst) AS ({_EDGE_ROWS}), t(g, source, sink) AS ({_END_ROWS}),
p(g, node, path) AS (SELECT g, source, [source] FROM t UNION ALL SELECT e.g, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.g = p.g AND e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND len(p.path) <= 15)
SELECT CAST(p.g AS INTEGER) AS graph_id, array_to_string(path, '>') AS path FROM p JOIN t ON t.g = p.g AND p.node = t.sink WHERE len(path) >= 2""")
def attack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of at most 15 edges from sources to sinks, by a recursive query."""
    return spark.sql(f"""WITH RECURSIVE e(g, src, dst) AS ({_EDGE_ROWS}), t(g, source, sink) AS ({_END_ROWS}),
p(g, node, path) AS (SELECT g, source, array(source) FROM t UNION ALL SELECT e.g, e.dst, array_append(p.path, e.dst) FROM p JOIN e ON e.g = p.g AND e.src = p.node WHERE NOT array_contains(p.path, e.dst) AND size(p.path) <= 15)
SELECT p.g AS graph_id, array_join(path, '>') AS path FROM p JOIN t ON t.g = p.g AND p.node = t.sink WHERE size(path) >= 2""")


_REACH = ("Confirmed Reachable", "Reachability Eliminated", "Requires Manual Review", "Unverifiable")
_GRID = f"""SELECT CAST(row_number() OVER (ORDER BY env, xss, param, valid, reach NULLS FIRST, has_path) AS BIGINT) AS case_id, * FROM
 (VALUES (true), (false)) a(env) CROSS JOIN (VALUES ('none'), ('confirmed'), ('scoped')) b(xss) CROSS JOIN (VALUES (true), (false)) c(param) CROSS JOIN (VALUES (true), (false)) d(valid)
 CROSS JOIN (VALUES {", ".join(f"('{r}')" for r in _REACH)}, (NULL)) e(reach) CROSS JOIN (VALUES (true), (false)) f(has_path)"""


@query(f"""SELECT case_id, CASE WHEN xss = 'confirmed' THEN 'Confirmed' WHEN xss = 'scoped' OR param OR valid THEN 'Out-of-scope' WHEN reach = 'Confirmed Reachable' THEN 'Confirmed' ELSE 'Unverified' END AS status,
CASE WHEN xss <> 'none' THEN 'xss context' WHEN param THEN 'parameterised' WHEN valid THEN 'validated' WHEN reach = 'Confirmed Reachable' THEN 'reachable' WHEN NOT has_path AND (reach IS NULL OR reach = 'Unverifiable') THEN 'pattern only' WHEN env THEN 'environment' ELSE 'no rule' END AS reason FROM ({_GRID})""")
def verdict_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict ladder in closed form over its truth table: one column expression, no loop over rules."""
    c = F.col
    reached = F.coalesce(c("reach") == "Confirmed Reachable", F.lit(False))
    scoped = (c("xss") == "scoped") | c("param") | c("valid")
    status = F.when(c("xss") == "confirmed", "Confirmed").when(scoped, "Out-of-scope").when(reached, "Confirmed").otherwise("Unverified")
    reason = F.when(c("xss") != "none", "xss context").when(c("param"), "parameterised").when(c("valid"), "validated").when(reached, "reachable")
    reason = reason.when(~c("has_path") & (c("reach").isNull() | (c("reach") == "Unverifiable")), "pattern only").when(c("env"), "environment").otherwise("no rule")
    return spark.sql(_GRID).select("case_id", status.alias("status"), reason.alias("reason"))


_DIFF = "+++ b/a.py\n@@ -1,2 +1,3 @@\n ctx\n+new\n-old\n+more\n@@ -10,1 +20,2 @@\n keep\n+add\n+++ b/b.py\n@@ -0,0 +1 @@\n+only\n\\ No newline at end of file\n"


@query("SELECT * FROM (VALUES ('a.py', 2), ('a.py', 3), ('a.py', 21), ('b.py', 1)) v(path, line_no)")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of a unified diff: headers carried forward, then a running count of the new file's lines."""
    from ..sources.diffs import changed_lines

    return changed_lines(spark.createDataFrame([(1, _DIFF)], "diff_id long, text string")).select("path", "line_no")


_FIXES = [("cfg = yaml.load(f)", "yaml"), ("h = hashlib.md5(x)", "hash"), ("app.run(debug=True)", "debug"), ('cur.execute(f"SELECT {x}")', "none"), ('password = "hunter2hunter2"', "secret")]
_FIX_ROWS = "VALUES " + ", ".join(f"({k}, {_q(a)})" for k, (a, _) in enumerate(_FIXES))


@query(f"""SELECT CAST(k AS INTEGER) AS k, line, fixed, line <> fixed AS is_functional FROM (SELECT k, line, replace(regexp_replace(regexp_replace(regexp_replace(line, 'yaml\\.load\\(([^),]+)\\)', 'yaml.safe_load(\\1)'), 'hashlib\\.(md5|sha1)\\(', 'hashlib.sha256('),
 '^(\\s*)(\\w*password\\w*)\\s*=\\s*[\"''][^\"'']+[\"'']', '\\1\\2 = os.environ[\"PASSWORD\"]'), 'debug=True', 'debug=False') AS fixed FROM ({_FIX_ROWS}) v(k, line))""")
def fix_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rewrites by pattern, and whether a line was changed."""
    c = F.regexp_replace("line", r"yaml\.load\(([^),]+)\)", "yaml.safe_load($1)")
    c = F.regexp_replace(c, r"hashlib\.(md5|sha1)\(", "hashlib.sha256(")
    c = F.regexp_replace(c, r"^(\s*)(\w*password\w*)\s*=\s*[\"'][^\"']+[\"']", '$1$2 = os.environ["PASSWORD"]')
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(_FIXES)], "k int, line string").withColumn("fixed", F.replace(c, F.lit("debug=True"), F.lit("debug=False")))
    return rows.withColumn("is_functional", F.col("line") != F.col("fixed"))


__all__ = ["catalog", "Window", "pat"]
