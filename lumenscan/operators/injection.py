"""Sinks near tainted variables, and calls that span lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grown, is_code, lines, pat
from .detectors import tainted_variables


@dataclass(frozen=True)
class Sink:
    name: str
    vulnerability_type: str
    cwe_id: str
    pattern: str
    before: int
    after: int
    severity: str = "CRITICAL"
    confidence: float = 0.90


# Languages, how a variable gets user input, and the sinks with the lines around them that count.
LANGUAGES = ("python", "javascript", "typescript")
SOURCE = r"(\w+)\s*=\s*(?:urllib\.parse\.unquote_plus\s*\()?(?:request\.(?:cookies|form|args|json|headers|data)(?:\.get(?:list)?)?|input\s*\(|params\[|sys\.argv)"
XPATH = Sink("XPathInjectionDetector", "XPath Injection", "CWE-643", r"(?i)(?:lxml\.etree\.XPath|elementpath\.select|\.xpath)\s*\(", 5, 0)
LDAP = Sink("LDAPInjectionDetector", "LDAP Injection", "CWE-90", r"(?i)(?:conn|connection|ldap_conn|l)\.search(?:_s|_ext|_ext_s)?\s*\(|(?:filter|ldap_filter|search_filter)\s*=\s*(?:f['\"]|['\"].*?[%+])", 7, 2)
INSECURE = r"(?i)secure\s*=\s*False"


def _finding(name: str, kind: str, severity: str, cwe: str, confidence: float) -> list[Column]:
    return [F.lit(name).alias("detector_name"), F.lit(kind).alias("vulnerability_type"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe_id"), F.lit(confidence).alias("confidence")]


def near_taint(files: DataFrame, sink: Sink) -> DataFrame:
    """Findings of a sink with a tainted variable in its frame; tainted_var is the least such name.

    Sink lines are few: their frames are dealt to line numbers and equi-joined with the lines that hold a tainted word, so
    no line is searched for every variable. Files without a sink leave before their lines are made."""
    some = files.filter(F.col("language").isin(*LANGUAGES) & F.col("code").rlike(pat(sink.pattern)))
    rows = lines(some)
    sinks = rows.filter(is_code(F.col("line")) & F.col("line").rlike(pat(sink.pattern))).select("file_id", F.col("line_no").alias("line_number"), F.explode(F.sequence(F.col("line_no") - sink.before, F.col("line_no") + sink.after)).alias("line_no"))
    words = rows.select("file_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(pat(r"(\w+)")), 1))).alias("var"))
    held = words.join(grown(tainted_variables(some, SOURCE, comments=True)), ["file_id", "var"])
    found = sinks.join(grown(held), ["file_id", "line_no"]).groupBy("file_id", "line_number").agg(F.min("var").alias("tainted_var"))
    return found.select("file_id", "line_number", *_finding(sink.name, sink.vulnerability_type, sink.severity, sink.cwe_id, sink.confidence), "tainted_var")


def insecure_cookies(files: DataFrame) -> DataFrame:
    """Cookie calls with secure=False. A call runs from its line until its parentheses balance, or to the file's end.

    Calls are nested or apart, so those within an earlier one are the ones that start before the latest end so far."""
    rest = files.filter(F.col("code").contains("set_cookie")).select("file_id", F.split("code", "\n", -1).alias("all")).select("file_id", "all", F.posexplode("all").alias("pos", "line")).filter(F.col("line").contains("set_cookie"))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(acc: Column, line: Column) -> Column:
        depth = acc["depth"] + count(line, "(") - count(line, ")")
        return F.when(acc["open"], F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth > 0).alias("open"))).otherwise(acc)

    below = F.slice("all", F.col("pos") + 1, F.size("all"))
    calls = rest.withColumn("n", F.aggregate(below, start, take)["n"]).select("file_id", "pos", (F.col("pos") + F.col("n")).alias("until"), F.array_join(F.slice("all", F.col("pos") + 1, F.col("n")), "\n").alias("call"))
    earlier = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    outer = calls.withColumn("taken", F.coalesce(F.max("until").over(earlier), F.lit(0))).filter("pos >= taken")
    return outer.filter(F.col("call").rlike(pat(INSECURE))).select("file_id", (F.col("pos") + 1).alias("line_number"), *_finding("SecureCookieDetector", "Insecure Cookie", "HIGH", "CWE-614", 0.95))
