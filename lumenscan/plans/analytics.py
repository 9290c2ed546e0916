"""Dashboards and reports over findings.

The driver's tables stand in for the warehouse: an order is a scan, a line item a finding, a customer a project, an
event a job's progress message, a label an expected result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
_F = """(SELECT l_orderkey AS scan_id, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal, CASE l_returnflag || l_linestatus WHEN 'NF' THEN 'CRITICAL' WHEN 'AF' THEN 'HIGH' WHEN 'RF' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  'type-' || CAST(l_suppkey % 20 AS VARCHAR) AS vulnerability_type, CAST(l_quantity AS INTEGER) AS line_number, CAST(l_partkey % 5 AS INTEGER) AS reach FROM lineitem)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ordinal"),
        F.when(flags == "NF", "CRITICAL").when(flags == "AF", "HIGH").when(flags == "RF", "MEDIUM").otherwise("LOW").alias("severity"),
        F.concat(F.lit("type-"), (F.col("l_suppkey") % 20).cast("string")).alias("vulnerability_type"),
        F.round("l_quantity").cast("int").alias("line_number"), (F.col("l_partkey") % 5).cast("int").alias("reach"),
    )


def _levels() -> list:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in LEVELS]


_LEVELS_SQL = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in LEVELS)


@query(f"SELECT scan_id, {_LEVELS_SQL} FROM {_F} GROUP BY scan_id")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("scan_id").agg(*_levels())


@query(f"SELECT vulnerability_type, count(*) AS n FROM {_F} GROUP BY 1")
def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("vulnerability_type").agg(F.count(F.lit(1)).alias("n"))


_BUCKETS = ("Confirmed Reachable", "Reachability Eliminated", "Requires Manual Review", "Unverifiable", "Not Analysed")


@query(f"SELECT b.bucket, count(f.reach) AS n FROM (VALUES {', '.join(f'({k}, {b!r})' for k, b in enumerate(_BUCKETS))}) b(k, bucket) LEFT JOIN {_F} f ON f.reach = b.k GROUP BY 1")
def reachability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket has a row; findings are counted before the join."""
    buckets = spark.createDataFrame(list(enumerate(_BUCKETS)), "reach int, bucket string")
    counted = findings(spark, sf_dir).groupBy("reach").agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counted, "reach", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT o.o_orderkey AS scan_id, f.ordinal, f.vulnerability_type, o.o_orderdate AS detected FROM {_F} f JOIN orders o ON o.o_orderkey = f.scan_id WHERE f.severity = 'CRITICAL'")
def critical_findings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    critical = findings(spark, sf_dir).filter("severity = 'CRITICAL'")
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("detected"))
    return critical.join(scans, "scan_id").orderBy(F.desc("detected")).select("scan_id", "ordinal", "vulnerability_type", "detected")


@query(f"SELECT o.o_custkey AS project, count(DISTINCT o.o_orderkey) AS scans, count(f.scan_id) AS findings FROM orders o LEFT JOIN {_F} f ON f.scan_id = o.o_orderkey GROUP BY 1")
def scan_summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are counted per scan first, so the join has a row a scan."""
    per_scan = findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project"))
    return scans.join(per_scan, "scan_id", "left").groupBy("project").agg(F.count(F.lit(1)).alias("scans"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


@query("SELECT o_orderkey AS scan_id, o_orderdate AS scanned FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_scans_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("scanned"))


@query(f"SELECT scan_id, ordinal, severity, line_number, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY severity, line_number, ordinal) AS INTEGER) AS alphabetic, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY CASE severity {' '.join(f'WHEN {s!r} THEN {k}' for k, s in enumerate(LEVELS))} END, line_number, ordinal) AS INTEGER) AS ranked FROM {_F}")
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of severity: alphabetic and by rank."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    at = Window.partitionBy("scan_id")
    return findings(spark, sf_dir).select("scan_id", "ordinal", "severity", "line_number", F.row_number().over(at.orderBy("severity", "line_number", "ordinal")).alias("alphabetic"), F.row_number().over(at.orderBy(rank, "line_number", "ordinal")).alias("ranked"))


_DAY = f"SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, CAST(count(*) FILTER (severity = 'CRITICAL') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'HIGH') AS BIGINT) AS high FROM {_F} JOIN orders ON o_orderkey = scan_id GROUP BY 1"


@query(_DAY)
def daily_severity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_scan = findings(spark, sf_dir).groupBy("scan_id").agg(*_levels())
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.to_date("o_orderdate").alias("day"))
    return per_scan.join(scans, "scan_id").groupBy("day").agg(F.sum("critical").alias("critical"), F.sum("high").alias("high"))


@query(f"SELECT * FROM ({_DAY}) ORDER BY day DESC LIMIT 12")
def trend_last12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_severity_trend(spark, sf_dir).orderBy(F.desc("day")).limit(12)


@query(f"SELECT o_custkey AS project, CASE WHEN count(scan_id) = 0 THEN 'N/A' WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'F' WHEN count(*) FILTER (severity = 'HIGH') > 5 THEN 'D' WHEN count(*) FILTER (severity = 'HIGH') > 0 THEN 'C' WHEN count(scan_id) > 10 THEN 'B' ELSE 'A' END AS rating FROM orders LEFT JOIN {_F} ON scan_id = o_orderkey GROUP BY 1")
def security_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_scan = findings(spark, sf_dir).groupBy("scan_id").agg(*_levels(), F.count(F.lit(1)).alias("n"))
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project"))
    sums = scans.join(per_scan, "scan_id", "left").groupBy("project").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("critical", "high", "n")))
    rating = F.when(F.col("n") == 0, "N/A").when(F.col("critical") > 0, "F").when(F.col("high") > 5, "D").when(F.col("high") > 0, "C").when(F.col("n") > 10, "B").otherwise("A")
    return sums.select("project", rating.alias("rating"))


@query(f"SELECT count(*) AS findings, {_LEVELS_SQL}, count(DISTINCT scan_id) AS files FROM {_F}")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("findings"), *_levels(), F.countDistinct("scan_id").alias("files"))


@query(f"SELECT vulnerability_type, count(*) AS n FROM {_F} GROUP BY 1 ORDER BY n DESC, vulnerability_type LIMIT 8")
def vuln_types_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_by_type(spark, sf_dir).orderBy(F.desc("n"), "vulnerability_type").limit(8)


_PHASE = "CASE WHEN reach < 3 THEN 'before' ELSE 'after' END"


@query(f"SELECT phase, vulnerability_type, n FROM (SELECT {_PHASE} AS phase, vulnerability_type, count(*) AS n FROM {_F} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY phase ORDER BY n DESC, vulnerability_type) <= 10")
def vuln_types_top10_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = findings(spark, sf_dir).groupBy(F.expr(_PHASE).alias("phase"), "vulnerability_type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("n"), "vulnerability_type"))
    return counted.withColumn("rank", rank).filter("rank <= 10").drop("rank")


@query(f"SELECT severity, before, before - after AS reduced, CAST(floor(100.0 * (before - after) / before + 0.5) AS BIGINT) AS percent FROM (SELECT severity, count(*) FILTER (reach < 3) AS before, count(*) FILTER (reach >= 3) AS after FROM {_F} GROUP BY 1)")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixes took away, in percent rounded half up."""
    n = findings(spark, sf_dir).groupBy("severity").agg(F.count_if(F.col("reach") < 3).alias("before"), F.count_if(F.col("reach") >= 3).alias("after"))
    return n.select("severity", "before", (F.col("before") - F.col("after")).alias("reduced"), F.when(F.col("before") == 0, 0).otherwise(F.floor(100 * (F.col("before") - F.col("after")) / F.col("before") + 0.5)).cast("long").alias("percent"))


@query(f"SELECT reach, n, CAST(floor(100.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS percent FROM (SELECT reach, count(*) AS n FROM {_F} GROUP BY 1)")
def trust_gradient_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = findings(spark, sf_dir).groupBy("reach").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).cast("long"))


@query("SELECT coalesce(source, 'analyzed_file') AS source, lang AS target, count(*) AS weight FROM documents GROUP BY 1, 2")
def sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("analyzed_file")).alias("source"), F.col("lang").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


@query(f"SELECT scan_id, vulnerability_type, count(*) AS n, arg_min(severity, (ordinal, severity)) AS first_severity FROM {_F} GROUP BY 1, 2")
def file_vuln_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("scan_id", "vulnerability_type").agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", F.struct("ordinal", "severity")).alias("first_severity"))


_MATRIX = "count(*) FILTER (found AND bad) AS tp, count(*) FILTER (found AND NOT bad) AS fp, count(*) FILTER (NOT found AND NOT bad) AS tn, count(*) FILTER (NOT found AND bad) AS fn"


@query(f"SELECT coalesce(lang, 'overall') AS category, tp, fp, tn, fn, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS tpr, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 9) AS fpr FROM (SELECT lang, {_MATRIX} FROM (SELECT lang, quality = 0 AS bad, regexp_matches(text, '[#*$%&|]{{3}}') AS found FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang))")
def confusion_matrix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against detected, per category and overall in one rollup."""
    found = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike(r"[#*$%&|]{3}").alias("found"))
    rows = found.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    f, b = F.col("found"), F.col("bad")
    n = rows.rollup("lang").agg(F.count_if(f & b).alias("tp"), F.count_if(f & ~b).alias("fp"), F.count_if(~f & ~b).alias("tn"), F.count_if(~f & b).alias("fn"))
    rate = lambda x, y: F.round(F.when(F.col(x) + F.col(y) == 0, 0.0).otherwise(F.col(x) / (F.col(x) + F.col(y))), 9)
    return n.select(F.coalesce("lang", F.lit("overall")).alias("category"), "tp", "fp", "tn", "fn", rate("tp", "fn").alias("tpr"), rate("fp", "tn").alias("fpr"))


@query("SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, event_id LIMIT 50")
def history_upsert_cap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key, then the newest 50."""
    newest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("e"))
    return newest.select("e.event_id", "e.ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query(f"SELECT scan_id, severity, '### ' || CAST(row_number() OVER (PARTITION BY scan_id, severity ORDER BY ordinal, vulnerability_type) AS VARCHAR) || '. ' || vulnerability_type AS heading FROM {_F}")
def markdown_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("scan_id", "severity").orderBy("ordinal", "vulnerability_type"))
    return findings(spark, sf_dir).select("scan_id", "severity", F.concat(F.lit("### "), k.cast("string"), F.lit(". "), F.col("vulnerability_type")).alias("heading"))


@query("SELECT doc_id, substr(text, 1, 200) AS description FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def pr_comment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty items with their descriptions cut to 200 characters."""
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", F.substring("text", 1, 200).alias("description"))


_KEY = "o_custkey, o_orderpriority"
_BEFORE, _AFTER = "o_orderstatus = 'F'", "o_orderstatus <> 'F'"


def _phases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return o.filter(_BEFORE), o.filter(_AFTER)


def _set_sql(rows: str, sign: str, other: str) -> str:
    return f"SELECT o_orderkey FROM orders x WHERE {rows} AND {sign} EXISTS (SELECT 1 FROM orders y WHERE y.{other} AND y.o_custkey = x.o_custkey AND y.o_orderpriority = x.o_orderpriority)"


@query(_set_sql(_BEFORE, "NOT", _AFTER))
def paths_eliminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _phases(spark, sf_dir)
    return before.join(after, ["o_custkey", "o_orderpriority"], "left_anti").select("o_orderkey")


@query(_set_sql(_AFTER, "", _BEFORE))
def paths_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _phases(spark, sf_dir)
    return after.join(before, ["o_custkey", "o_orderpriority"], "left_semi").select("o_orderkey")


@query(_set_sql(_AFTER, "NOT", _BEFORE))
def paths_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _phases(spark, sf_dir)
    return after.join(before, ["o_custkey", "o_orderpriority"], "left_anti").select("o_orderkey")


@query(f"SELECT x.o_orderkey, coalesce(a.o_orderstatus, 'Eliminated') AS status FROM orders x LEFT JOIN (SELECT {_KEY}, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE {_AFTER} GROUP BY 1, 2) a ON a.o_custkey = x.o_custkey AND a.o_orderpriority = x.o_orderpriority WHERE x.{_BEFORE}")
def reclassify_after_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row before with the first row after of its key."""
    before, after = _phases(spark, sf_dir)
    first = after.groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderstatus", "o_orderkey").alias("now"))
    return before.join(first, ["o_custkey", "o_orderpriority"], "left").select("o_orderkey", F.coalesce("now", F.lit("Eliminated")).alias("status"))


@query("SELECT DISTINCT source FROM documents")
def kb_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct()


@query("SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, sha256(substr(text, k * 800 + 1, 1000)) AS chunk_hash FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS k FROM documents)")
def kb_chunk_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1000 characters that share 200 with the next."""
    n = F.greatest(F.lit(1), F.ceil((F.char_length("text") - 200) / 800).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.sha2(F.substr("text", F.col("chunk_no") * 800 + 1, F.lit(1000)), 256).alias("chunk_hash"))


_Q = "(SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
_COS = "round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)"


@query(f"SELECT q_id, vec_id, {_COS} AS similarity FROM {_Q}, embeddings WHERE vec_id <> q_id QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY {_COS} DESC, vec_id) <= 4")
def kb_cosine_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest vectors of every twentieth one, in blocks: each task keeps its best four of each query."""
    from ..operators.vectors import nearest

    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.filter("vec_id % 20 = 0"), 4)


@query("SELECT event_type, count(*) AS n, CAST(max(CASE event_type WHEN 'error' THEN 1 ELSE 0 END) AS INTEGER) AS failed FROM events GROUP BY 1")
def job_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failed"))


_FALLBACK = {"SQL Injection": "Use parameters.", "Hardcoded Secret": "Read it from the environment.", "Weak Hash": "Use SHA-256.", "Insecure Cookie": "Set Secure."}


@query(f"SELECT p_partkey, coalesce(f.advice, 'Review this finding.') AS advice FROM part LEFT JOIN (VALUES {', '.join(f'({k}, {v!r})' for k, v in enumerate(_FALLBACK.values()))}) f(k, advice) ON f.k = p_partkey % 6")
def llm_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    advice = spark.createDataFrame(list(enumerate(_FALLBACK.values())), "k long, advice string")
    return table(spark, sf_dir, "part").join(advice, F.col("p_partkey") % 6 == F.col("k"), "left").select("p_partkey", F.coalesce("advice", F.lit("Review this finding.")).alias("advice"))


@query("SELECT doc_id, concat_ws(' | ', CASE WHEN n_chars > 1000 THEN 'Confirmed' END, lang, 'path: ' || source) AS evidence FROM documents")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" | ", F.when(F.col("n_chars") > 1000, "Confirmed"), "lang", F.concat(F.lit("path: "), "source")).alias("evidence"))


@query("SELECT source AS directory, bool_or(contains(lower(text), 'license')) AS is_library, bool_or(contains(text, 'token')) AS has_secrets, count(*) AS files FROM documents GROUP BY 1")
def project_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.groupBy(F.col("source").alias("directory")).agg(F.bool_or(F.contains(F.lower("text"), F.lit("license"))).alias("is_library"), F.bool_or(F.contains("text", F.lit("token"))).alias("has_secrets"), F.count(F.lit(1)).alias("files"))
