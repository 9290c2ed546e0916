"""Triage, reports and sinks over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from .analytics import _F, _PHASE, LEVELS, findings

_RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(LEVELS)) + " END"


def severity_rank() -> F.Column:
    """0 for the gravest level."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity")).cast("int") - 1


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("scanned"), F.col("o_orderstatus").alias("state"))


@query(f"SELECT scan_id, ordinal, severity FROM {_F} WHERE severity IN ('CRITICAL', 'HIGH')")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels a user has picked."""
    return findings(spark, sf_dir).filter(F.col("severity").isin("CRITICAL", "HIGH")).select("scan_id", "ordinal", "severity")


@query(f"SELECT scan_id, ordinal, lower(severity) AS severity, vulnerability_type AS type, line_number AS line, 'Line ' || CAST(line_number AS VARCHAR) || ': ' || vulnerability_type AS title FROM {_F}")
def finding_api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the API hands to a page."""
    title = F.concat(F.lit("Line "), F.col("line_number").cast("string"), F.lit(": "), "vulnerability_type")
    return findings(spark, sf_dir).select("scan_id", "ordinal", F.lower("severity").alias("severity"), F.col("vulnerability_type").alias("type"), F.col("line_number").alias("line"), title.alias("title"))


@query(f"SELECT scan_id, ordinal, severity, vulnerability_type FROM {_F} WHERE scan_id = (SELECT max(o_orderkey) FROM orders)")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's findings by its id, here that of the newest scan: the id is pushed down to the reader."""
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return findings(spark, sf_dir).filter(F.col("scan_id") == F.lit(newest)).select("scan_id", "ordinal", "severity", "vulnerability_type")


_TOTALS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in LEVELS)


@query(f"SELECT {_PHASE} AS phase, {_TOTALS}, count(*) AS total FROM {_F} GROUP BY 1")
def sandbox_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals before and after the fixes."""
    return findings(spark, sf_dir).groupBy(F.expr(_PHASE).alias("phase")).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in LEVELS), F.count(F.lit(1)).alias("total"))


@query(f"SELECT vulnerability_type, count(*) FILTER (reach < 3) AS functional, count(*) FILTER (reach = 3) AS rejected, count(*) AS total, CAST(count(*) FILTER (reach < 3) AS VARCHAR) || ' fixed, ' || CAST(count(*) FILTER (reach >= 3) AS VARCHAR) || ' guidance' AS summary FROM {_F} GROUP BY 1")
def fix_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reach")
    text = F.concat(F.count_if(r < 3).cast("string"), F.lit(" fixed, "), F.count_if(r >= 3).cast("string"), F.lit(" guidance"))
    return findings(spark, sf_dir).groupBy("vulnerability_type").agg(F.count_if(r < 3).alias("functional"), F.count_if(r == 3).alias("rejected"), F.count(F.lit(1)).alias("total"), text.alias("summary"))


@query("""WITH m AS (SELECT coalesce(lang, 'overall') AS category, count(*) FILTER (found AND bad)::DOUBLE AS tp, count(*) FILTER (found AND NOT bad)::DOUBLE AS fp, count(*) FILTER (NOT found AND NOT bad)::DOUBLE AS tn, count(*) FILTER (NOT found AND bad)::DOUBLE AS fn
  FROM (SELECT lang, quality = 0 AS bad, regexp_matches(text, '[#*$%&|]{3}') AS found FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)),
r AS (SELECT category, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS tpr, CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS fpr FROM m)
SELECT category, round(accuracy, 9) AS accuracy, round(p, 9) AS precision, round(CASE WHEN p + tpr = 0 THEN 0 ELSE 2 * p * tpr / (p + tpr) END, 9) AS f1, round(tpr - fpr, 9) AS score FROM r""")
def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision, F1 and TPR - FPR, per category and overall; 0 where a denominator is 0."""
    found = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike(r"[#*$%&|]{3}").alias("found"))
    rows = found.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    f, b = F.col("found"), F.col("bad")
    n = rows.rollup("lang").agg(F.count_if(f & b).alias("tp"), F.count_if(f & ~b).alias("fp"), F.count_if(~f & ~b).alias("tn"), F.count_if(~f & b).alias("fn"))
    ratio = lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(x / y)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    r = n.select(F.coalesce("lang", F.lit("overall")).alias("category"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"))
    p, t = F.col("p"), F.col("tpr")
    return r.select("category", F.round("accuracy", 9).alias("accuracy"), F.round("p", 9).alias("precision"), F.round(ratio(2 * p * t, p + t), 9).alias("f1"), F.round(t - F.col("fpr"), 9).alias("score"))


@query(f"SELECT state, sum(n) FILTER (state <> 'P') AS findings, count(*) AS scans, count(*) FILTER (n > 0) AS with_findings FROM (SELECT o_orderstatus AS state, count(f.scan_id) AS n FROM orders LEFT JOIN {_F} f ON f.scan_id = o_orderkey GROUP BY o_orderkey, o_orderstatus) GROUP BY 1".replace("sum(n) FILTER (state <> 'P')", "CAST(coalesce(sum(n) FILTER (state <> 'P'), 0) AS BIGINT)"))
def directory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings summed over successful scans (those not pending), beside all scans."""
    per_scan = findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    rows = scans(spark, sf_dir).join(per_scan, "scan_id", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("state").agg(F.coalesce(F.sum(F.when(F.col("state") != "P", F.col("n"))), F.lit(0)).alias("findings"), F.count(F.lit(1)).alias("scans"), F.count_if(F.col("n") > 0).alias("with_findings"))


@query("SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS edges FROM (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS node FROM lineitem UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem)")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nodes and distinct edges of a graph; equal edges are dropped before the nodes are counted."""
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    ends = edges.select(F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("node"))
    return ends.agg(F.countDistinct("node").alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query(f"SELECT scan_id, reach, count(*) AS n FROM {_F} GROUP BY 1, 2")
def status_counts_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("scan_id", "reach").agg(F.count(F.lit(1)).alias("n"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_scan = findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    return scans(spark, sf_dir).join(per_scan, "scan_id")


_HISTORY = f"(SELECT o_orderkey AS scan_id, o_orderdate AS scanned, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical FROM orders JOIN {_F} ON scan_id = o_orderkey GROUP BY 1, 2)"


@query(f"SELECT * FROM {_HISTORY} ORDER BY critical DESC, total DESC, scanned, scan_id LIMIT 50")
def history_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the history by the columns a user sorts by."""
    return _history(spark, sf_dir).select("scan_id", "scanned", "total", "critical").orderBy(F.desc("critical"), F.desc("total"), "scanned", "scan_id").limit(50)


@query("SELECT scan_id, severity, n FROM (SELECT o_orderkey AS scan_id, s.severity, (SELECT count(*) FROM " + _F + " f WHERE f.scan_id = o_orderkey AND f.severity = s.severity) AS n FROM orders, (VALUES " + ", ".join(f"('{s}')" for s in LEVELS) + ") s(severity)) WHERE n > 0")
def severity_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of four levels without the empty ones."""
    wide = findings(spark, sf_dir).groupBy("scan_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in LEVELS))
    return wide.unpivot("scan_id", list(LEVELS), "severity", "n").filter("n > 0")


@query(f"SELECT scan_id, ordinal, severity, line_number, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY line_number DESC, ordinal, severity) AS INTEGER) AS turn FROM {_F} WHERE reach = 0")
def fix_targets_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are edited from the last to the first, so that numbers stay right."""
    turn = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("line_number"), "ordinal", "severity"))
    return findings(spark, sf_dir).filter("reach = 0").select("scan_id", "ordinal", "severity", "line_number", turn.alias("turn"))


_NULLED = f"(SELECT *, CASE WHEN reach = 4 THEN NULL ELSE line_number END AS line FROM {_F})"


@query(f"SELECT scan_id, ordinal, severity, line, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY line NULLS LAST, ordinal, severity) AS INTEGER) AS by_line, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY vulnerability_type DESC, ordinal, severity) AS INTEGER) AS by_type_desc FROM {_NULLED}")
def findings_table_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings table by line, rows without one last, and by type downwards."""
    at = Window.partitionBy("scan_id")
    rows = findings(spark, sf_dir).withColumn("line", F.when(F.col("reach") != 4, F.col("line_number")))
    return rows.select("scan_id", "ordinal", "severity", "line", F.row_number().over(at.orderBy(F.asc_nulls_last("line"), "ordinal", "severity")).alias("by_line"), F.row_number().over(at.orderBy(F.desc("vulnerability_type"), "ordinal", "severity")).alias("by_type_desc"))


@query(f"SELECT reach, sum(n)::BIGINT AS n FROM (SELECT reach, count(*) AS n FROM {_F} WHERE {_PHASE} = 'before' GROUP BY 1 UNION ALL SELECT reach, count(*) FROM {_F} WHERE {_PHASE} <> 'before' GROUP BY 1) GROUP BY 1")
def reach_union_of_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).withColumn("phase", F.expr(_PHASE))
    return f.filter("phase = 'before'").select("reach").unionAll(f.filter("phase <> 'before'").select("reach")).groupBy("reach").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events in the order in which they first came; only first ones meet in one row."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda e: e["event_type"])
    return first.groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("kinds"))


_KEY4 = ("l_partkey", "l_returnflag", "l_linenumber", "l_suppkey")
_EQ4 = " AND ".join(f"y.{c} = x.{c}" for c in _KEY4)
_B4, _A4 = "l_linestatus = 'F'", "l_linestatus <> 'F'"


def _compare(spark: SparkSession, sf_dir: str, left: str, right: str, how: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", *_KEY4)
    return rows.filter(left).join(rows.filter(right).select(*_KEY4), list(_KEY4), how).select("l_orderkey", *_KEY4)


def _compare_sql(left: str, sign: str, right: str) -> str:
    return f"SELECT l_orderkey, {', '.join(_KEY4)} FROM lineitem x WHERE {left} AND {sign} EXISTS (SELECT 1 FROM lineitem y WHERE y.{right} AND {_EQ4})"


@query(_compare_sql(_B4, "NOT", _A4))
def flows_eliminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first phase whose four-part key is gone: bag semantics, rows stay as often as they occur."""
    return _compare(spark, sf_dir, _B4, _A4, "left_anti")


@query(_compare_sql(_A4, "", _B4))
def flows_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(spark, sf_dir, _A4, _B4, "left_semi")


@query(_compare_sql(_A4, "NOT", _B4))
def flows_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compare(spark, sf_dir, _A4, _B4, "left_anti")


@query("SELECT source AS source_name, lang AS sink_name, count(*) AS n FROM documents x WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents y WHERE y.doc_id % 2 = 1 AND y.source = x.source AND y.lang = x.lang) GROUP BY 1, 2")
def ui_paths_eliminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's coarse comparison, by names alone: even documents are the first phase, odd ones the second."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("sink_name"))
    return d.filter("doc_id % 2 = 0").join(d.filter("doc_id % 2 = 1").select("source_name", "sink_name").distinct(), ["source_name", "sink_name"], "left_anti").groupBy("source_name", "sink_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH old AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'), new AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
f AS (SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.ts = new.ts))
SELECT event_id, fresh FROM (SELECT event_id, true AS fresh, ts FROM f UNION ALL SELECT event_id, false, ts FROM old) ORDER BY fresh DESC, ts DESC, event_id LIMIT 50""")
def history_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries that the history doesn't hold go before it; the newest 50 stay."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    old, new = e.filter("event_type <> 'error'"), e.filter("event_type = 'error'")
    fresh = new.join(old.select("user_id", "ts"), ["user_id", "ts"], "left_anti").select("event_id", F.lit(True).alias("fresh"), "ts")
    return fresh.union(old.select("event_id", F.lit(False), "ts")).orderBy(F.desc("fresh"), F.desc("ts"), "event_id").limit(50).select("event_id", "fresh")


@query("SELECT DISTINCT 'source:' || source AS node, 'source' AS kind FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT 'sink:' || lang, 'sink' FROM documents WHERE lang IS NOT NULL")
def sankey_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.struct(F.concat(F.lit("source:"), "source").alias("node"), F.lit("source").alias("kind")), F.struct(F.concat(F.lit("sink:"), "lang").alias("node"), F.lit("sink").alias("kind")))
    return table(spark, sf_dir, "documents").select("source", "lang").distinct().select(F.explode(ends).alias("e")).select("e.*").filter("node is not null").distinct()


def per_scan_text(rows: DataFrame, piece: F.Column, between: str) -> F.Column:
    """The pieces of a scan's findings in order, in one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "severity", "line_number", piece.alias("piece")))), lambda x: x["piece"]), between)


def _agg_sql(piece: str, between: str) -> str:
    return f"string_agg({piece}, {between} ORDER BY ordinal, severity, line_number, {piece})"


_MD = "'- **' || severity || '** line ' || CAST(line_number AS VARCHAR) || ': ' || vulnerability_type"


@query(f"SELECT scan_id, '# Scan ' || CAST(scan_id AS VARCHAR) || chr(10) || chr(10) || 'Findings: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || {_agg_sql(_MD, 'chr(10)')} || chr(10) AS report FROM {_F} GROUP BY 1")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report per scan."""
    f = findings(spark, sf_dir)
    piece = F.concat(F.lit("- **"), "severity", F.lit("** line "), F.col("line_number").cast("string"), F.lit(": "), "vulnerability_type")
    text = F.concat(F.lit("# Scan "), F.col("scan_id").cast("string"), F.lit("\n\nFindings: "), F.col("n").cast("string"), F.lit("\n\n"), "body", F.lit("\n"))
    return f.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), per_scan_text(f, piece, "\n").alias("body")).select("scan_id", text.alias("report"))


_TR = "'<tr><td>' || severity || '</td><td>' || CAST(line_number AS VARCHAR) || '</td><td>' || vulnerability_type || '</td></tr>'"


@query(f"SELECT scan_id, '<table><tr><th>Severity</th><th>Line</th><th>Type</th></tr>' || {_agg_sql(_TR, chr(39) * 2)} || '</table>' AS report FROM {_F} GROUP BY 1")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import html_escape

    f = findings(spark, sf_dir)
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>"))
    piece = F.concat(F.lit("<tr>"), cell(F.col("severity")), cell(F.col("line_number").cast("string")), cell(F.col("vulnerability_type")), F.lit("</tr>"))
    return f.groupBy("scan_id").agg(F.concat(F.lit("<table><tr><th>Severity</th><th>Line</th><th>Type</th></tr>"), per_scan_text(f, piece, ""), F.lit("</table>")).alias("report"))


_JS = """'{"severity":"' || severity || '","line":' || CAST(line_number AS VARCHAR) || ',"type":"' || vulnerability_type || '"}'"""


@query(f"""SELECT scan_id, '{{"scan_id":' || CAST(scan_id AS VARCHAR) || ',"total_findings":' || CAST(count(*) AS VARCHAR) || ',"findings":[' || {_agg_sql(_JS, "','")} || '],"attack_paths":[],"reachability":[]}}' AS report FROM {_F} GROUP BY 1""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report per scan; paths and reachability are left empty here."""
    f = findings(spark, sf_dir)
    row = F.struct("ordinal", "severity", "line_number", "vulnerability_type")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["severity"].alias("severity"), x["line_number"].alias("line"), x["vulnerability_type"].alias("type")))
    none = F.array().cast("array<string>")
    return f.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), rows.alias("fs")).select("scan_id", F.to_json(F.struct("scan_id", F.col("n").alias("total_findings"), F.col("fs").alias("findings"), none.alias("attack_paths"), none.alias("reachability"))).alias("report"))


@query(f"SELECT scan_id, concat_ws(', ', {', '.join(f'''CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN '{s}: ' || CAST(count(*) FILTER (severity = '{s}') AS VARCHAR) END''' for s in LEVELS)}) AS summary FROM {_F} GROUP BY 1")
def console_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings(spark, sf_dir).groupBy("scan_id").agg(F.concat_ws(", ", *(F.when(n(s) > 0, F.concat(F.lit(f"{s}: "), n(s).cast("string"))) for s in LEVELS)).alias("summary"))


@query(f"""SELECT project, string_agg(item, chr(10) ORDER BY k) FILTER (k <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '... and ' || CAST(count(*) - 20 AS VARCHAR) || ' more' ELSE '' END AS comment FROM (
  SELECT o_custkey AS project, '- ' || severity || ' ' || vulnerability_type AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK_SQL}, scan_id, ordinal, vulnerability_type) AS k FROM {_F} JOIN orders ON o_orderkey = scan_id) GROUP BY 1""")
def pr_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review comment per project: the gravest 20 findings and how many more there are. Only 20 rows a project are joined into text."""
    rows = findings(spark, sf_dir).join(scans(spark, sf_dir).select("scan_id", "project"), "scan_id")
    totals = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("project").orderBy(severity_rank(), "scan_id", "ordinal", "vulnerability_type")
    top = rows.withColumn("k", F.row_number().over(best)).filter("k <= 20")
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- "), "severity", F.lit(" "), "vulnerability_type").alias("item")))), lambda x: x["item"])
    text = top.groupBy("project").agg(F.array_join(items, "\n").alias("body")).join(totals, "project")
    return text.select("project", F.concat("body", F.when(F.col("n") > 20, F.concat(F.lit("\n... and "), (F.col("n") - 20).cast("string"), F.lit(" more"))).otherwise("")).alias("comment"))


@query("""SELECT event_id, 'event: ' || CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'progress' END || chr(10) || 'data: {"user":' || CAST(user_id AS VARCHAR) || ',"type":"' || event_type || '"}' || chr(10) || chr(10) AS message FROM events""")
def sse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").otherwise("progress")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))), F.lit("\n\n")).alias("message"))


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM (SELECT min(source) FROM documents)")
def kb_delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the knowledge base when a source, here the first by name, is deleted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(d.agg(F.min("source").alias("gone")), F.col("source") == F.col("gone"), "left_anti").select("doc_id")


@query("SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS report_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def report_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each job."""
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy(F.col("user_id").alias("job_id")).agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("report_id"))


_CSV = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '# ' WHEN doc_id % 11 = 0 THEN 'short,' ELSE '' END || 'case-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '' ELSE ',' || CASE quality WHEN 1 THEN 'sqli' ELSE 'xss' END || ',' || CASE toxic WHEN 1 THEN 'true' ELSE 'False' END || ', ' || CAST(79 + doc_id % 9 AS VARCHAR) END AS line FROM labels)"


@query(f"SELECT split_part(line, ',', 1) AS name, trim(split_part(line, ',', 2)) AS category, lower(trim(split_part(line, ',', 3))) = 'true' AS vulnerable, CAST(trim(split_part(line, ',', 4)) AS INTEGER) AS cwe FROM {_CSV} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND len(string_split(line, ',')) >= 4")
def expected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected results from lines of text, one made of each label: no blank ones, no comments, four fields at least."""
    from ..sources.expected import parse_expected

    id_ = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 7 == 0, "# ").when(F.col("doc_id") % 11 == 0, "short,").otherwise("")
    rest = F.concat(F.lit(","), F.when(F.col("quality") == 1, "sqli").otherwise("xss"), F.lit(","), F.when(F.col("toxic") == 1, "true").otherwise("False"), F.lit(", "), (79 + F.col("doc_id") % 9).cast("string"))
    line = F.concat(head, F.lit("case-"), id_, F.when(F.col("doc_id") % 11 == 0, "").otherwise(rest))
    return parse_expected(table(spark, sf_dir, "labels").select(line.alias("line")))


_NORM = "lower(regexp_replace({}, '[^A-Za-z]', '', 'g'))"


@query(f"SELECT e.mktsegment AS expected, d.priority AS detected FROM (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer) e JOIN (SELECT DISTINCT p_type AS priority FROM part) d ON contains({_NORM.format('e.mktsegment')}, {_NORM.format('d.priority')}) OR contains({_NORM.format('d.priority')}, {_NORM.format('e.mktsegment')})")
def category_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and detected categories where one name contains the other, letters only. Names are made distinct first: a
    catalogue's names, not its rows, meet here."""
    norm = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    e = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("expected")).distinct().withColumn("x", norm("expected"))
    d = table(spark, sf_dir, "part").select(F.col("p_type").alias("detected")).distinct().withColumn("y", norm("detected"))
    return e.join(d, F.contains("x", F.col("y")) | F.contains("y", F.col("x"))).select("expected", "detected")


__all__ = ["per_scan_text", "scans", "severity_rank"]
