"""Findings about web handlers, prompts and agents' tools: rules over lines, their frames and whole files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_in, frame, is_code, lines, pat
from .injection import LANGUAGES, Sink, _finding

OPERATIONAL = "OperationalSecurityDetector"


@dataclass(frozen=True)
class LineRule:
    vulnerability_type: str
    severity: str
    cwe_id: str
    confidence: float
    pattern: str
    need: tuple[str, int, int]  # must match in a line of the frame (pattern, lines before, lines after)
    skip: tuple[str, int, int]  # must not match there


# The patterns, hints and frames that results must agree on.
ROUTE = r"(?i)^\s*@(?:\w+\.)?route\s*\("
LIMITER = r"(?i)^\s*@(?:\w+\.)?(?:limit|limiter\.limit|rate_limit)\s*\("
CSRF_HINTS = r"(?i)csrf|flask_wtf|csrfprotect|validate_csrf|WTF_CSRF_ENABLED"
HEADER_HINTS = r"(?i)Content-Security-Policy|Strict-Transport-Security|X-Frame-Options|X-Content-Type-Options|Referrer-Policy|Permissions-Policy"
CHANGING = r"(?i)methods\s*=\s*\[[^\]]*(POST|PUT|PATCH|DELETE)"
UPLOAD = LineRule("Unsafe File Upload", "HIGH", "CWE-434", 0.90, r"\.save\s*\(", (r"(?i)filename|request\.files|f['\"].*\{", 0, 0), (r"(?i)secure_filename|allowed_(?:file|ext|extension|extensions)|content_type|mimetype|magic\.from_buffer|MAX_CONTENT_LENGTH", 7, 0))
DISCLOSURE = LineRule("Information Disclosure", "MEDIUM", "CWE-200", 0.88, r"(?i)os\.environ|dict\s*\(\s*os\.environ\s*\)|sys\.version|platform\.|traceback\.format_exc|__file__|SECRET_KEY|API_KEY", (r"return|jsonify|Response|make_response", 3, 3), (r"if\s+.*(?:app\.debug|DEBUG|current_app\.debug)\s*:", 3, 3))
RATE_LIMIT = LineRule("Missing Rate Limiting", "MEDIUM", "CWE-770", 0.58, ROUTE, (r"(?i)login|auth|token|upload|search|api", 0, 5), (LIMITER, 3, 1))
TRUST = Sink("TrustBoundaryDetector", "Trust Boundary Violation", "CWE-501", r"(?:flask\.)?session\s*\[|(?:flask\.)?g\.\w+\s*=|app\.config\s*\[", 0, 0, "HIGH", 0.88)
AI_WORDS = "prompt|system_prompt|user_prompt|instruction|gpt|openai|anthropic|claude|llm|ai_model|completion|chat|message"
PROMPT_PATTERNS = (
    r"f[\"'].*?\{user[_\w]*\}", r"f[\"'].*?\{.*?input\(\)", r"\+\s*user[_\w]*", r"user[_\w]*\s*\+", r"\.format\(.*?user", r"`.*?\$\{user[_\w]*\}",
    r"`.*?\$\{.*?prompt\(", r"prompt\s*=\s*[\"'].*?[\"'].*?\+.*?user", r"system_prompt.*?\+.*?user",
)
AGENT_WORDS = "agent|tool|function_call|tool_call|langchain|llm_tool|ai_tool|agent_executor|tools=|available_functions|function_calling"
TOOL_DEFINITION = r"(?i)@tool|Tool\(|def\s+\w+_tool\(|tools\s*=\s*\[|function_calling"
AGENT_LINES = 50
OPERATIONS = (
    "delete_file", "remove_file", "os.remove", "os.unlink", "os.rmdir", "shutil.rmtree", "rm -rf", "drop table", "drop database", "truncate table", "delete from", "exec(", "eval(",
    "os.system", "subprocess.run", "subprocess.call", "subprocess.popen", "shell=true", "sudo", "os.chmod", "os.chown", "format_disk", "mkfs", "destroy", "terminate", "kill",
)
# What opens a configuration, what it may not grant, and user input for prompts.
CONFIG_OPENS = r"""def\s+config\s*\(|["']?(?:config|settings|permissions)["']?\s*[=:]\s*\{"""
DANGERS = (
    ("Shell Access", r"""["']shell["']\s*:\s*True"""),
    ("Delete Permission", r"""["'](?:filesystem|permissions|tools)["']\s*:\s*\[.*?["']delete["'].*?\]"""),
    ("Write+Delete Permissions", r"""\[.*?["']write["'].*?["']delete["'].*?\]"""),
    ("Elevated Privileges", r"""["'](?:admin|root|sudo|elevated)["']?\s*:\s*True"""),
    ("Execute Permission", r"""["'](?:execute|exec|run)["']?\s*:\s*True"""),
    ("Unrestricted Access", r"""["'](?:full_access|all_permissions|unrestricted)["']?\s*:\s*True"""),
)
PROMPT_SOURCE = r"(\w+)\s*=\s*(?:input\(|request\.form|request\.json|params\[)"
PROMPT_WORDS = r"(?i)\b(?:prompt|system_prompt|gpt|openai|anthropic|claude|llm|completion|chat)\b"


def _like(pattern: str, column: str = "line") -> Column:
    return F.col(column).rlike(pat(pattern))


def _python(files: DataFrame) -> DataFrame:
    return files.filter("language = 'python'")


def line_rule(files: DataFrame, rule: LineRule) -> DataFrame:
    """Lines of the rule whose frame has what it needs and nothing that excuses it. Comments count, as they may hold hints.

    Files without the pattern leave before their lines are made."""
    some = _python(files).filter(F.col("code").rlike("(?m)" + pat(rule.pattern)))
    rows = lines(some).select("*", any_in(_like(rule.need[0]), *rule.need[1:]).alias("needed"), any_in(_like(rule.skip[0]), *rule.skip[1:]).alias("excused"))
    found = rows.filter(_like(rule.pattern) & F.col("needed") & ~F.col("excused"))
    return found.select("file_id", F.col("line_no").alias("line_number"), *_finding(OPERATIONAL, rule.vulnerability_type, rule.severity, rule.cwe_id, rule.confidence))


def missing_headers(files: DataFrame) -> DataFrame:
    """One finding for a web application without security headers, at the first line that makes it, else at line 1."""
    apps = _python(files).filter((F.col("code").rlike("(?m)" + pat(ROUTE)) | F.col("code").contains("Flask(")) & ~_like(HEADER_HINTS, "code"))
    before = F.substring_index("code", "Flask(", 1)
    at = F.when(F.col("code").contains("Flask("), F.regexp_count(before, F.lit("\n")) + 1).otherwise(1)
    return apps.select("file_id", at.cast("int").alias("line_number"), *_finding(OPERATIONAL, "Missing Security Headers", "MEDIUM", "CWE-693", 0.60))


def missing_csrf(files: DataFrame) -> DataFrame:
    """The first route of a file that changes state, where nothing in the file mentions a protection."""
    some = _python(files).filter(~_like(CSRF_HINTS, "code") & F.col("code").rlike("(?m)" + pat(ROUTE)))
    region = F.array_join(F.collect_list("line").over(frame(0, 7)), "\n")
    routes = lines(some).withColumn("region", region).filter(_like(ROUTE) & _like(CHANGING, "region"))
    first = routes.groupBy("file_id").agg(F.min("line_no").alias("line_number"))
    return first.select("file_id", "line_number", *_finding(OPERATIONAL, "Missing CSRF Protection", "HIGH", "CWE-352", 0.62))


def prompt_lines(files: DataFrame) -> DataFrame:
    """A row for each match of each pattern on lines that speak of a language model."""
    rows = lines(files.filter(F.col("language").isin(*LANGUAGES))).filter(is_code(F.col("line"), slashes=True) & F.lower("line").rlike(AI_WORDS))

    def matches(k: int) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pat(PROMPT_PATTERNS[k], True)), F.lit(0)), lambda m: F.struct(F.lit(k).alias("pattern_no"), m.alias("matched_text")))

    hits = rows.select("file_id", F.col("line_no").alias("line_number"), F.explode(F.concat(*map(matches, range(len(PROMPT_PATTERNS))))).alias("hit"))
    return hits.select("file_id", "line_number", "hit.*", *_finding("PromptInjectionDetector", "Prompt Injection", "CRITICAL", "CWE-74", 0.95))


def agent_operations(files: DataFrame) -> DataFrame:
    """A row for each dangerous operation on a line that defines a tool or stands within AGENT_LINES of a word for agents."""
    rows = lines(files.filter(F.col("language").isin(*LANGUAGES)))
    rows = rows.withColumn("near", any_in(F.lower("line").rlike(AGENT_WORDS), AGENT_LINES, 0)).filter(F.col("near") | _like(TOOL_DEFINITION))
    held = F.filter(F.array(*map(F.lit, OPERATIONS)), lambda o: F.contains(F.lower("line"), o))
    hits = rows.select("file_id", F.col("line_no").alias("line_number"), F.explode(held).alias("operation"))
    return hits.select("file_id", "line_number", "operation", *_finding("OverprivilegedToolsDetector", "Over-Privileged AI Tool", "HIGH", "CWE-269", 0.90))


def _dangers(text: Column, flags: str) -> Column:
    """Names of the grants that the text holds, in order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?{flags}dU)" + p), F.lit(name)) for name, p in DANGERS)))


def permission_configs(files: DataFrame) -> DataFrame:
    """Configuration blocks that grant too much, by the line that opens them, and single lines outside of blocks.

    A block runs from its opening line to the first later line where its braces are balanced or a function begins. An
    opening line inside a block starts anew and the block before is lost; lines of a block that never ends are swallowed.
    So every opening line starts a segment, whatever came before: its number is a running count, its braces a running sum
    within it, and its end the first balanced line. Lines after the end, and the end itself, count as outside."""
    some = files.filter(F.col("language").isin(*LANGUAGES)).filter(reduce(lambda a, b: a | b, (F.col("code").rlike("(?isdU)" + p) for _, p in DANGERS)))
    of_file, of_segment = Window.partitionBy("file_id").orderBy("line_no"), Window.partitionBy("file_id", "segment").orderBy("line_no")
    whole = of_segment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines(some).withColumn("opens", _like(CONFIG_OPENS)).withColumn("segment", F.count_if("opens").over(of_file))
    rows = rows.withColumn("depth", F.sum(F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))).over(of_segment))
    closes = ~F.col("opens") & (F.col("segment") > 0) & ((F.col("depth") <= 0) | _like(r"^\s*def "))
    rows = rows.withColumn("until", F.min(F.when(closes, F.col("line_no"))).over(whole))
    inside = rows.filter("segment > 0 and line_no <= until")
    blocks = inside.groupBy("file_id", "segment").agg(F.min("line_no").alias("line_number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    held = blocks.select("file_id", "line_number", F.array_join(_dangers(F.col("text"), "is"), ", ").alias("dangers")).filter("dangers <> ''")
    outside = rows.filter((F.col("segment") == 0) | (F.col("line_no") >= F.col("until"))).select("file_id", F.col("line_no").alias("line_number"), F.get(_dangers(F.col("line"), "i"), F.lit(0)).alias("dangers")).filter("dangers is not null")
    of = lambda kind, confidence: _finding("OverprivilegedToolsDetector", kind, "HIGH", "CWE-269", confidence)
    return held.select("file_id", "line_number", "dangers", *of("Overly Permissive AI Config", 0.90)).unionByName(outside.select("file_id", "line_number", "dangers", *of("Dangerous Permission Setting", 0.85)))


def prompt_flow(files: DataFrame) -> DataFrame:
    """Lines that speak of a model and use a variable that took user input on another line above: one finding a line, for the
    variable that took input first. Taking input again moves the line of a variable, not its place: on that line it is
    passed over."""
    some = files.filter(F.col("language").isin(*LANGUAGES) & F.col("code").rlike(pat(PROMPT_SOURCE)) & F.col("code").rlike(PROMPT_WORDS))
    source = lambda x: F.regexp_extract(x, pat(PROMPT_SOURCE), 1)
    numbered = some.withColumn("all", F.transform(F.split("code", "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))))
    taken = F.transform(F.filter("all", lambda x: x["line"].rlike(pat(PROMPT_SOURCE))), lambda x: F.struct(x["n"].alias("n"), source(x["line"]).alias("var")))
    first = F.aggregate("taken", F.filter("taken", lambda t: F.lit(False)), lambda held, t: F.when(F.exists(held, lambda h: h["var"] == t["var"]), held).otherwise(F.concat(held, F.array(t))))

    def one(x: Column) -> Column:
        words = F.regexp_extract_all(x["line"], F.lit(pat(r"(\w+)")), 1)
        due = F.filter("first", lambda t: (t["n"] < x["n"]) & F.array_contains(words, t["var"]) & (t["var"] != source(x["line"])))
        return F.struct(x["n"].alias("line_number"), F.get(due, F.lit(0))["var"].alias("user_variable"))

    hits = F.filter(F.transform(F.filter("all", lambda x: x["line"].rlike(PROMPT_WORDS)), one), lambda h: h["user_variable"].isNotNull())
    rows = numbered.withColumn("taken", taken).withColumn("first", first).select("file_id", F.inline(hits))
    return rows.select("file_id", "line_number", "user_variable", *_finding("PromptInjectionDetector", "Prompt Injection", "CRITICAL", "CWE-74", 0.85))
