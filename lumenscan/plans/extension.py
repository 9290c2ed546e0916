"""Queries over extension points and replies' texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import replies as R
from ..operators import extension as X
from ..operators import union as U
from .flows import all_files
from .scanning import _ALL, _q
from .union import _part_sql


class LongWords:
    """A user's detector: lines with a word of 40 characters or more."""

    def eval(self, code: str, language: str, path: str):
        for k, line in enumerate((code or "").split("\n"), 1):
            if any(len(w) >= 40 for w in line.split(" ")):
                yield k, "Long Word", "LOW", "CWE-0", 0.5


@query(f"""SELECT file_id, CAST(line_no AS INTEGER) AS line_number, 'LongWords' AS detector_name, 'Long Word' AS vulnerability_type, 'LOW' AS severity, 'CWE-0' AS cwe_id, CAST(0.5 AS DOUBLE) AS confidence
FROM (SELECT file_id, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT file_id, string_split(code, chr(10)) AS p FROM {_ALL})) WHERE len(list_filter(string_split(line, ' '), lambda w: length(w) >= 40)) > 0""")
def det_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of a user's own, as a table function."""
    return X.detect_with(all_files(spark, sf_dir), "LongWords", LongWords)


_ON = {name: name in ("det_hardcoded_secret", "det_weak_hash", "det_cookie", "det_permissions", "det_ops_debug") for name, _ in U.PARTS}


@query(" UNION ALL ".join(f"SELECT {', '.join(U.COLUMNS)}, {k} AS det_ord FROM ({_part_sql(name)})" for k, (name, _) in enumerate(U.PARTS) if _ON[name]))
def det_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors that are switched on."""
    return X.enabled_findings(all_files(spark, sf_dir), _ON)


_TAILS = ("to stop prom", "against SQL inject", "in every case", "it is done.", "more secur", "```\\nx = 1", "```a``` and more", "see (docs)", "two.. dots  and", "")
_TAIL = f"replace(list_extract([{', '.join(_q(t) for t in _TAILS)}], CAST(page_id % {len(_TAILS)} AS INTEGER) + 1), '\\n', chr(10))"
_COMPLETED = " ".join(f"WHEN ends_with(last, {_q(k)}) THEN {_q(v)}" for k, v in R.COMPLETIONS.items())


@query(f"""WITH a AS (SELECT page_id, trim('  ' || url || chr(10) || 'use  it ' || {_TAIL} || ' ') AS t FROM pages),
b AS (SELECT page_id, CASE WHEN (length(t) - length(replace(t, '```', ''))) // 3 % 2 = 1 THEN t || chr(10) || '```' ELSE t END AS t FROM a),
c AS (SELECT page_id, t, regexp_extract_all(t, '\\S+') AS w, rtrim(lower(regexp_extract(t, '(\\S+)$', 1)), '.,!?;:') AS last FROM b),
d AS (SELECT page_id, t, w, CASE {_COMPLETED} END AS ending FROM c)
SELECT page_id, trim(replace(replace(CASE WHEN right(t, 1) IN ('.', '!', '?', '"', '''', ')', ']', '}}') THEN t WHEN ending IS NOT NULL THEN array_to_string(w[:-2], ' ') || ' ' || ending ELSE t || '.' END, '..', '.'), '  ', ' ')) AS reply FROM d""")
def reply_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, one made of each page, with open fences closed and cut last words completed."""
    tail = F.element_at(F.array(*(F.lit(t.replace("\\n", "\n")) for t in _TAILS)), (F.col("page_id") % len(_TAILS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", R.polish(F.concat(F.lit("  "), "url", F.lit("\nuse  it "), tail, F.lit(" "))).alias("reply"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\\t\\n\\x0b\\x0c\\r ]+|[^\\t\\n\\x0b\\x0c\\r ]+') AS w FROM conversations),
g(conv_id, turn, k, done, cur) AS (SELECT conv_id, turn, 0, CAST([] AS VARCHAR[]), '' FROM t
  UNION ALL SELECT conv_id, turn, k, CASE WHEN flush AND rtrim(cur) <> '' THEN list_append(done, rtrim(cur)) ELSE done END, CASE WHEN drop THEN cur WHEN NOT flush THEN cur || x WHEN blank THEN '' ELSE x END
  FROM (SELECT *, x = repeat(' ', length(x)) AS blank, blank AND cur = '' AND len(done) > 0 AS drop, NOT drop AND length(cur) + length(x) > 60 AS flush
    FROM (SELECT g.conv_id, g.turn, g.k + 1 AS k, g.done, g.cur, regexp_replace(t.w[g.k + 1], '[\\t\\n\\x0b\\x0c\\r ]', ' ', 'g') AS x FROM g JOIN t ON t.conv_id = g.conv_id AND t.turn = g.turn AND g.k < len(t.w)))),
e AS (SELECT g.conv_id, g.turn, CASE WHEN rtrim(cur) <> '' THEN list_append(done, rtrim(cur)) ELSE done END AS rows FROM g JOIN t ON t.conv_id = g.conv_id AND t.turn = g.turn AND g.k = len(t.w))
SELECT conv_id, turn, CAST(len(rows) AS INTEGER) AS n_rows, sha256(array_to_string(rows, chr(10))) AS wrapped FROM e""")
def wrap_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations wrapped at 60 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", R.wrap(F.coalesce("text", F.lit("")), 60).alias("w"))
    return rows.select("conv_id", "turn", F.when(F.col("w") == "", 0).otherwise(F.size(F.split("w", "\n"))).alias("n_rows"), F.sha2("w", 256).alias("wrapped"))


_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


@query(f"""SELECT doc_id, CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS INTEGER) AS n_lines, CAST(length(coalesce(p[1], '')) AS INTEGER) AS first_chars FROM (SELECT doc_id, string_split_regex(text, {_q(_BREAKS)}) AS p FROM documents WHERE text IS NOT NULL)""")
def lines_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by every kind of line break; a break at the end opens no further line."""
    p = F.split("text", _BREAKS, -1)
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", p.alias("p"))
    return rows.select("doc_id", (F.size("p") - F.when(F.element_at("p", -1) == "", 1).otherwise(0)).alias("n_lines"), F.char_length(F.element_at("p", 1)).alias("first_chars"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY vulnerability_type) AS INTEGER) AS place, vulnerability_type, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT vulnerability_type FROM ({_part_sql(name)})' for name, _ in U.PARTS if _ON[name])}) GROUP BY 2")
def findings_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the findings by name."""
    from pyspark.sql import Window

    counts = X.enabled_findings(all_files(spark, sf_dir), _ON).groupBy("vulnerability_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.row_number().over(Window.orderBy("vulnerability_type")).alias("place"), "vulnerability_type", "n")
