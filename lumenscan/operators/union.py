"""All detectors over one set of files, in the order of registration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.warehouse import written
from . import detectors as D
from . import injection as I
from . import scoped as S
from . import web as W

COLUMNS = ("file_id", "line_number", "detector_name", "vulnerability_type", "severity", "cwe_id", "confidence")


def races(files: DataFrame) -> DataFrame:
    """Uses after a check, as findings."""
    return D.toctou(files).select("file_id", "line_number", *I._finding("TOCTOUDetector", "TOCTOU Race Condition", "HIGH", "CWE-367", 0.85))


def _table(detector: D.Detector):
    return lambda files: D.detect(files, detector)


def _rule(rule: W.LineRule):
    return lambda files: W.line_rule(files, rule)


def _near(sink: I.Sink):
    return lambda files: I.near_taint(files, sink)


#: Query of each part, and the part. Its place is det_ord, which breaks ties when findings are deduplicated.
PARTS = (
    ("det_prompt_lines", W.prompt_lines), ("det_prompt_flow", W.prompt_flow), ("det_hardcoded_secret", _table(D.SECRETS)), ("det_agent_operations", W.agent_operations), ("det_tool_lists", S.tool_lists), ("det_permissions", W.permission_configs), ("det_weak_random", _table(D.WEAK_RANDOM)),
    ("det_weak_hash", _table(D.WEAK_HASH)), ("det_sql_injection", S.sql_injection), ("det_xpath", _near(I.XPATH)), ("det_xxe", S.xml_entities), ("det_deserialization", _table(D.DESERIALIZATION)),
    ("det_cookie", I.insecure_cookies), ("det_trust_boundary", _near(W.TRUST)), ("det_ldap", _near(I.LDAP)), ("det_reflection", _table(D.REFLECTION)), ("det_crypto", _table(D.CRYPTO)),
    ("det_temp_file", _table(D.TEMP_FILE)), ("det_races", races), ("det_memory", _table(D.MEMORY)), ("det_type_confusion", _table(D.TYPE_CONFUSION)), ("det_log_injection", S.log_injection), ("det_xss", S.cross_site_scripting),
    ("det_encoded_path", S.encoded_paths), ("det_quoted_shell", S.quoted_shells), ("det_signed_loads", S.signed_loads), ("det_upload", _rule(W.UPLOAD)), ("det_disclosure", _rule(W.DISCLOSURE)),
    ("det_open_redirect", S.open_redirects), ("det_memory_exhaustion", S.memory_exhaustion), ("det_format_string", S.format_strings), ("det_ops_debug", _table(D.DEBUG)),
    ("det_missing_headers", W.missing_headers), ("det_missing_csrf", W.missing_csrf), ("det_rate_limit", _rule(W.RATE_LIMIT)),
)


#: What a file must hold for the parts that look at files of any language; the others look at LANGUAGES only.
_TABLES = (D.SECRETS, D.WEAK_RANDOM, D.WEAK_HASH, D.DESERIALIZATION, D.REFLECTION, D.CRYPTO, D.TEMP_FILE, D.MEMORY, D.TYPE_CONFUSION, D.DEBUG)


def narrowed(files: DataFrame) -> DataFrame:
    """Files in which a part may find something, written: one scan of the texts, after which each part reads these alone."""
    gates = [F.contains("code", F.lit("set_cookie")), D.checks(), S.logs(), S.parsers(), *map(D.gate, _TABLES)]
    return written(files.filter(F.col("language").isin(*I.LANGUAGES) | reduce(lambda a, b: a | b, gates)), "candidates")


def all_findings(files: DataFrame, without: tuple[str, ...] = (), narrow: bool = True) -> DataFrame:
    """The union of the parts. Each part drops files that hold none of its patterns before it makes lines."""
    files = narrowed(files) if narrow else files
    parts = [f(files).select(*COLUMNS, F.lit(k).alias("det_ord")) for k, (name, f) in enumerate(PARTS) if name not in without]
    return reduce(DataFrame.unionAll, parts)


def scan(files: DataFrame) -> DataFrame:
    """The best finding of each file, line and type."""
    return D.dedup(all_findings(files))
