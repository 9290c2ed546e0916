"""Findings that hang on a whole file: user input that reaches logs, pages, redirects, sizes and formats, XML parsers under
any name, and guards that encodings or shells pass by.

A file stays one row with its lines as an array. Names, taint and regions are array expressions, only findings become rows
and nothing is shuffled by line; files without a sink leave first."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grown, is_code, pat
from .detectors import ASSIGN, SOURCE, SWEEPS
from .injection import LANGUAGES, _finding
from .web import OPERATIONS

# Sources, sinks, what excuses them and the lines around them that count.
LOG_SOURCE = r"(\w+)\s*=\s*(?:request\.|input\s*\(|params\[|sys\.argv)"
LOG_SINK = r"(?:logging|logger|log)\.(?:info|warning|error|debug|critical)\s*\(|\.write\s*\(\s*(?:log_entry|f['\"])"
LOG_WRITE = r"\.write\s*\("
LOG_CLEANED = r"\.replace\s*\(\s*['\"]\\n"
METHOD_PARAMETERS = r"^\s*def\s+\w+\s*\(self,?\s*(.*?)\)\s*:"
PAGE_SOURCES = (r"(\w+)\s*=\s*(?:parse_qs|request\.(?:args|form|json|cookies|headers))", r"(\w+)\s*=\s*\w+\.get\s*\(\s*['\"]")
PAGE_SINK = r"wfile\.write|send_response|response\.write|return\s+f['\"]|RESPONSE\s*\+=|response\s*=\s*f['\"]"
PAGE_RETURN = r"return\s+f['\"]"
PAGE_TAG = r"<\w+[>\s/]"
PAGE_ESCAPED = r"escape\s*\(\s*"
WEB_SOURCE = r"(?i)(\w+)\s*=\s*(?:request\.(?:files|form|args|json|headers|cookies|data)(?:\.get(?:list)?)?|input\s*\(|params\[|sys\.argv)"
REDIRECT = r"(?i)\bredirect\s*\(|meta\s+refresh|window\.location"
REDIRECT_SAFE = r"(?i)is_safe_url|url_has_allowed_host_and_scheme|allowed_hosts|urlparse|startswith\s*\(\s*['\"]/['\"]\s*\)"
REDIRECT_INPUT = r"request\.(?:args|form|values)\.get"
ALLOCATION = r"(?i)['\"].*['\"]\s*\*\s*int\s*\(|\[[^\]]*\]\s*\*\s*int\s*\(|bytearray\s*\(\s*int\s*\(|['\"].*['\"]\s*\*\s*(\w+)|\brange\s*\(\s*int\s*\("
BOUNDED = r"(?i)\bmin\s*\(|\bmax\s*\(|clamp|MAX_SIZE|MAX_LEN|MAX_BYTES|if\s+\w+\s*[<>]=?\s*\d+|if\s+\d+\s*[<>]=?\s*\w+"
PARAMETERS = r"^\s*def\s+\w+\s*\(([^)]*)\)"
FORMAT_CALL = r"(\w+)\.format\s*\("
FORMAT_INLINE = r"(?i)request\.(?:args|form|values)\.get\s*\(.+?\)\s*\.format\s*\("
FORMAT_PERCENT = r"(\w+)\s*%\s*[\(\w\[]"
XML_MODULES = r"xml\.etree\.ElementTree|xml\.etree\.cElementTree|xml\.sax\.expatreader|xml\.sax|xml\.dom\.minidom|xml\.dom\.pulldom|xml\.dom\.expatbuilder|xmlrpc"
XML_CALLS = r"(?:ET|ElementTree)\.(?:parse|fromstring|iterparse|XMLParser)\s*\(|sax\.(?:parse|parseString|make_parser)\s*\(|(?:minidom|pulldom|xml\.dom\.expatbuilder)\.(?:parse|parseString)\s*\("
XML_ENABLERS = r"setFeature\s*\([^,]*feature_external_ges\s*,\s*True|resolve_entities\s*=\s*True|load_dtd\s*=\s*True|no_network\s*=\s*False"
XML_SAFE = r"(?i)defusedxml|defused_xml"
XML_FUNCTIONS = "parse|fromstring|iterparse|XMLParser|parseString|make_parser|create_parser"
XML_MODULE_ALIAS = rf"import\s+(?:{XML_MODULES})\s+as\s+(\w+)"
XML_NAME_ALIAS = r"from\s+xml\.\S+\s+import\s+\w+\s+as\s+(\w+)"
SAFE_MODULE_ALIAS = r"import\s+defusedxml\S*\s+as\s+(\w+)"
SAFE_NAMES = (r"from\s+defusedxml\S*\s+import\s+\w+\s+as\s+(\w+)", r"from\s+defusedxml\S*\s+import\s+(\w+)$")
DOTS_GUARD = (r"(?:if|elif)\s+['\"]\.\.['\"]\s+in\s+(\w+)\s*:", r"(?:if|elif)\s+(\w+)\.find\(\s*['\"]\.\.['\"]\s*\)\s*!=\s*-?1\s*:")
DOTS_DECODED = r"unicodedata\.normalize|unquote|NFKC|NFKD"
QUOTED = r"\b(\w+)\s*=\s*shlex\.quote\s*\("
SHELL_CALL = r"\bsubprocess\.(?:run|call|Popen|check_output)\s*\("
SQL_SOURCE = "(?i)" + SOURCE
SQL_CALL = r"(?i)\.(?:execute|executemany)\s*\("
SQL_INLINE = r"(?i)\.(?:execute|executemany)\s*\(\s*f['\"]"
SQL_VARIABLE = r"(?i)\.(?:execute|executemany)\s*\(\s*(\w+)\s*\)"
SQL_PARAMETERS = r"(?i)\.(?:execute|executemany)\s*\([^,]+,\s*[\(\[]"
SQL_BUILT = (r"(?i)(?:query|sql|stmt)\s*=\s*f['\"]", r"(?i)(?:query|sql|stmt)\s*=\s*['\"].*?(?:\+|\%s|\%d|\%)")
SQL_BEFORE, SQL_AFTER = 11, 1
TOOL_LIST = r"(?is)tools\s*=\s*\[(.*?)\]"
DOTS_LINES, QUOTED_LINES = 30, 15
UNSAFE_LOADS = ("pickle.loads", "pickle.load", "yaml.load", "marshal.loads")
SIGNATURE_WORDS = ("verify", "signature", "hmac", "digest", "authentic")

EVASION = "EvasionPatternsDetector"
WORD = pat(r"(\w+)")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def _first(pattern: str) -> Column:
    """What the pattern's group takes first in each line that has it."""
    return F.filter(F.transform("all", lambda x: F.regexp_extract(x, pat(pattern), 1)), lambda v: v != "")


def _parameters(pattern: str) -> Column:
    """Names of parameters but `self`, without annotations and defaults; names with other characters than \\w are none."""
    name = lambda p: F.btrim(F.split(F.split(F.btrim(p), ":")[0], "=")[0])
    names = F.flatten(F.transform(_first(pattern), lambda g: F.transform(F.split(g, ","), name)))
    return F.filter(names, lambda v: v.rlike(pat(r"^\w+$")) & (v != "self"))


def tainted(files: DataFrame, seeds: Column) -> DataFrame:
    """Adds `all`, the lines, and `vars`, what the seeds reach in SWEEPS folds over the file's assignments; files without
    seeds go."""
    edge = lambda x: F.struct(F.regexp_extract(x, pat(ASSIGN), 1).alias("target"), F.array_distinct(words(F.regexp_extract(x, pat(ASSIGN), 2))).alias("words"))
    fire = lambda held, e: F.when(F.arrays_overlap(held, e["words"]), F.array_union(held, F.array(e["target"]))).otherwise(held)
    out = files.withColumn("all", F.split("code", "\n", -1)).withColumn("vars", F.array_distinct(seeds)).filter(F.size("vars") > 0)
    out = out.withColumn("edges", F.transform(F.filter("all", lambda x: x.rlike(pat(ASSIGN))), edge))
    for _ in range(SWEEPS):
        out = out.withColumn("vars", F.aggregate("edges", F.col("vars"), fire))
    return out.drop("edges")


def _sinks(pattern: str, before: int, after: int) -> Column:
    """line_no, line and the text of the region of each line that has the pattern."""

    def one(x: Column, i: Column) -> Column:
        low = F.greatest(i - before, F.lit(0))
        return F.when(x.rlike(pat(pattern)), F.struct((i + 1).alias("line_no"), x.alias("line"), F.array_join(F.slice("all", low + 1, i + after + 1 - low), "\n").alias("region")))

    return F.filter(F.transform("all", one), lambda h: h.isNotNull())


def _on(c: Column) -> Column:
    return F.array_intersect(words(c), F.col("vars"))


def _with(files: DataFrame, *patterns: str) -> DataFrame:
    """Files whose text has a pattern: no line of the others can."""
    return files.filter(reduce(lambda a, b: a | b, (F.col("code").rlike("(?m)" + pat(p)) for p in patterns)))


def logs() -> Column:
    """Whether a file may write a log."""
    cheap = reduce(lambda a, b: a | b, (F.contains("code", F.lit(x)) for x in (".info", ".warning", ".error", ".debug", ".critical", ".write")))
    return cheap & (F.col("code").rlike("(?m)" + pat(LOG_SINK)) | F.col("code").rlike("(?m)" + pat(LOG_WRITE)))


def parsers() -> Column:
    """Whether a file names a parser of XML."""
    return F.contains("code", F.lit("xml")) & F.col("code").rlike("(?m)" + pat(XML_MODULES))


def log_injection(files: DataFrame) -> DataFrame:
    """Log calls, or writes within nine lines of a word with `log`, of a tainted variable whose line feeds are not replaced.
    tainted_var is the least such name."""
    seeds = F.concat(_first(LOG_SOURCE), _parameters(METHOD_PARAMETERS))
    cleaned = lambda c: F.regexp_extract_all(c, F.lit(pat(r"(\w+)" + LOG_CLEANED)), F.lit(1))
    held = lambda h: F.filter(_on(h["line"]), lambda v: ~F.exists(cleaned(h["line"]), lambda c: F.endswith(c, v)))
    is_log = lambda h: h["line"].rlike(pat(LOG_SINK)) | h["region"].rlike(pat("log", True))
    hits = F.transform(F.filter(_sinks(f"{LOG_SINK}|{LOG_WRITE}", 9, 0), lambda h: is_code(h["line"]) & is_log(h)), lambda h: F.struct(h["line_no"].alias("line_number"), F.array_min(held(h)).alias("tainted_var")))
    rows = tainted(files.filter(logs()), seeds).select("file_id", F.inline(hits)).filter("tainted_var is not null")
    return rows.select("file_id", "line_number", *_finding("LogInjectionDetector", "Log Injection", "MEDIUM", "CWE-117", 0.85), "tainted_var")


def handlers(files: DataFrame) -> DataFrame:
    """Handlers after a route decorator, or do_* methods, and the last line of their bodies.

    A decorator waits through other decorators for its def; anything else cancels it. Lines of a file are one array, so the
    body's end is found in the handler's own row; only files with a route or such a method make rows at all."""
    some = files.filter(F.col("code").rlike(r"@(?:app|blueprint)\.route\b|def\s+do_(?:GET|POST|PUT|DELETE)\s*\("))
    indent = lambda c: F.char_length(c) - F.char_length(F.ltrim(c, F.lit(" \t")))
    blank = lambda c: F.btrim(c, F.lit(" \t\r\f")) == ""
    rows = some.select("file_id", F.split("code", "\n", -1).alias("all")).select("file_id", "all", F.posexplode("all").alias("pos", "line"))
    before = F.reverse(F.slice("all", 1, F.col("pos")))
    state = F.aggregate(before, F.lit("open"), lambda s, x: F.when(s != "open", s).when(x.rlike(r"@(?:app|blueprint)\.route\b"), "route").when(F.startswith(F.ltrim(x, F.lit(" \t")), F.lit("@")), "open").otherwise("none"))
    is_def = F.col("line").rlike(r"^\s*def\s+\w+\s*\(") & ~F.col("line").rlike(r"@(?:app|blueprint)\.route\b")
    heads = rows.filter(is_def).filter((state == "route") | F.col("line").rlike(r"^\s*def\s+do_(GET|POST|PUT|DELETE)\s*\("))
    below = F.slice("all", F.col("pos") + 2, F.size("all"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("last"), F.lit(True).alias("open"))

    def walk(a: Column, x: Column) -> Column:
        k = a["k"] + 1
        ends = ~blank(x) & (k > 1) & (indent(x) <= indent(F.col("line")))
        return F.when(a["open"] & ~ends, F.struct(k.alias("k"), F.when(blank(x), a["last"]).otherwise(k).alias("last"), F.lit(True).alias("open"))).otherwise(F.struct(k.alias("k"), a["last"].alias("last"), F.lit(False).alias("open")))

    end = F.aggregate(below, start, walk)["last"]
    return heads.select("file_id", (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1 + end).alias("end_line"))


def cross_site_scripting(files: DataFrame) -> DataFrame:
    """Responses inside a handler with a tainted variable that nothing escapes within four lines; a returned f-string must
    hold a tag. user_var is the least such name."""
    some = _with(files.filter(F.col("language").isin(*LANGUAGES)), PAGE_SINK)
    seeds = F.concat(*map(_first, PAGE_SOURCES))
    escaped = lambda c: F.regexp_extract_all(c, F.lit(pat(PAGE_ESCAPED + r"(\w+)")), F.lit(1))
    held = lambda h: F.filter(_on(h["line"]), lambda v: ~F.exists(escaped(h["region"]), lambda c: F.startswith(c, v)))
    html = lambda h: ~h["line"].rlike(pat(PAGE_RETURN)) | h["line"].rlike(pat(PAGE_TAG))
    hits = F.transform(F.filter(_sinks(PAGE_SINK, 3, 4), html), lambda h: F.struct(h["line_no"].alias("line_number"), F.array_min(held(h)).alias("user_var")))
    rows = tainted(some, seeds).select("file_id", F.inline(hits)).filter("user_var is not null")
    inside = rows.join(grown(handlers(some)), "file_id").filter("line_number between start_line and end_line").select("file_id", "line_number", "user_var").distinct()
    return inside.select("file_id", "line_number", *_finding("XSSDetector", "Reflected XSS", "HIGH", "CWE-79", 0.88), "user_var")


def sql_injection(files: DataFrame) -> DataFrame:
    """Statements executed from an f-string, or from a variable that user input reaches or near which a query is put together;
    calls with parameters are safe. sql_var is null for f-strings."""
    some = _with(files.filter("language = 'python'"), SQL_CALL)
    name = lambda h: F.nullif(F.regexp_extract(h["line"], pat(SQL_VARIABLE), 1), F.lit(""))
    inline = lambda h: h["line"].rlike(pat(SQL_INLINE))
    built = lambda h: h["region"].rlike(pat(SQL_BUILT[0])) | h["region"].rlike(pat(SQL_BUILT[1]))
    calls = F.filter(_sinks(SQL_CALL, SQL_BEFORE, SQL_AFTER), lambda h: is_code(h["line"]) & ~h["line"].rlike(pat(SQL_PARAMETERS)))
    hits = F.filter(calls, lambda h: inline(h) | (name(h).isNotNull() & (F.array_contains("vars", name(h)) | built(h))))
    rows = tainted(some, F.concat(_first(SQL_SOURCE), F.array(F.lit("")))).select("file_id", F.explode(hits).alias("h"))
    confidence = F.when(inline(F.col("h")), 0.92).otherwise(0.88).alias("confidence")
    var = F.when(~inline(F.col("h")), name(F.col("h"))).alias("sql_var")
    return rows.select("file_id", F.col("h.line_no").alias("line_number"), *_finding("SQLInjectionDetector", "SQL Injection", "CRITICAL", "CWE-89", 0.0)[:-1], confidence, var)


def tool_lists(files: DataFrame) -> DataFrame:
    """Lists of an agent's tools that hold dangerous operations, whatever lines they take; the list ends at its first closing
    bracket. line_number is that of the list's name, operations are its distinct ones in order."""
    p, breaks = pat(TOOL_LIST), lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    some = files.filter(F.col("language").isin(*LANGUAGES)).filter(F.col("code").rlike(p))
    lists = some.select("file_id", F.transform(F.split("code", p, -1), breaks).alias("between"), F.regexp_extract_all("code", F.lit(p), F.lit(0)).alias("all"), F.regexp_extract_all("code", F.lit(p), F.lit(1)).alias("held"))
    rows = lists.select("file_id", "between", F.transform("all", breaks).alias("within"), F.posexplode("held").alias("pos", "content"))
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, x: a + x)
    line = (1 + total("between", F.col("pos") + 1) + total("within", F.col("pos"))).alias("line_number")
    operations = F.array_sort(F.filter(F.array(*map(F.lit, OPERATIONS)), lambda o: F.contains(F.lower("content"), o)))
    found = rows.select("file_id", line, operations.alias("o")).filter(F.size("o") > 0)
    return found.select("file_id", "line_number", F.size("o").alias("n_operations"), F.array_join("o", ", ").alias("operations"), *_finding("OverprivilegedToolsDetector", "Over-Privileged AI Agent", "HIGH", "CWE-269", 0.95))


def _operational(files: DataFrame, seeds: Column, hits: Column, kind: str, severity: str, cwe: str, confidence: float) -> DataFrame:
    """`seeds` may be empty here, as requests on the line count too."""
    rows = tainted(files, F.concat(seeds, F.array(F.lit("")))).select("file_id", F.explode(hits).alias("h"))
    return rows.select("file_id", F.col("h.line_no").alias("line_number"), *_finding("OperationalSecurityDetector", kind, severity, cwe, confidence))


def open_redirects(files: DataFrame) -> DataFrame:
    """Redirects with user input in the seven lines before to the two lines after, and no check of the target there."""
    some = _with(files.filter("language = 'python'"), REDIRECT)
    hits = F.filter(_sinks(REDIRECT, 7, 2), lambda h: ~h["region"].rlike(pat(REDIRECT_SAFE)) & ((F.size(_on(h["region"])) > 0) | h["region"].rlike(pat(REDIRECT_INPUT))))
    return _operational(some, _first(WEB_SOURCE), hits, "Open Redirect", "HIGH", "CWE-601", 0.90)


def memory_exhaustion(files: DataFrame) -> DataFrame:
    """Allocations sized by user input or a parameter, without a bound in the five lines before to the line after.

    Parameters are seeds of the line's test only and taint nothing else."""
    some = _with(files.filter("language = 'python'"), ALLOCATION)
    own = lambda h: F.arrays_overlap(words(h["line"]), _parameters(PARAMETERS))
    hits = F.filter(_sinks(ALLOCATION, 5, 1), lambda h: is_code(h["line"]) & ~h["region"].rlike(pat(BOUNDED)) & ((F.size(_on(h["line"])) > 0) | own(h) | F.contains(h["line"], F.lit("request"))))
    return _operational(some, _first(WEB_SOURCE), hits, "Memory Exhaustion", "HIGH", "CWE-400", 0.91)


def format_strings(files: DataFrame) -> DataFrame:
    """Tainted templates of format() or %, and request values formatted in place; a line counts once, by the first of these."""
    some = _with(files.filter("language = 'python'"), FORMAT_CALL, FORMAT_PERCENT, FORMAT_INLINE)
    of = lambda h, p: F.array_contains("vars", F.nullif(F.regexp_extract(h["line"], pat(p), 1), F.lit("")))

    def kind(h: Column) -> Column:
        return F.when(of(h, FORMAT_CALL), "tainted_format_template").when(h["line"].rlike(pat(FORMAT_INLINE)), "request_template_format").when(of(h, FORMAT_PERCENT), "tainted_percent_template")

    hits = F.transform(F.filter(_sinks(f"{FORMAT_CALL}|{FORMAT_PERCENT}|{FORMAT_INLINE}", 0, 0), lambda h: is_code(h["line"])), lambda h: F.struct(h["line_no"].alias("line_number"), kind(h).alias("pattern")))
    rows = tainted(some, F.concat(_first(WEB_SOURCE), F.array(F.lit("")))).select("file_id", F.inline(hits)).filter("pattern is not null")
    sure = F.when(F.col("pattern") == "request_template_format", 0.89).otherwise(0.86)
    return rows.select("file_id", "line_number", *_finding("OperationalSecurityDetector", "Format String Injection", "MEDIUM", "CWE-134", 0.86)[:-1], sure.alias("confidence"), "pattern")


def xml_entities(files: DataFrame) -> DataFrame:
    """Parsers of the standard library by full name or any alias, and switches that let external entities in.

    A line gives one finding of a switch and one of a call: by full name, else by a module's alias, else by a function's."""
    every = lambda part, p: F.flatten(F.transform(part, lambda x: F.regexp_extract_all(x, F.lit(pat(p)), F.lit(1))))
    some = files.filter(parsers()).withColumn("all", F.split("code", "\n", -1))
    imports, safe = F.filter("all", lambda x: x.rlike(pat(XML_MODULES))), F.transform(F.filter("all", lambda x: F.contains(x, F.lit("defusedxml"))), lambda x: F.btrim(x, F.lit(" \t\r\f")))
    names = some.select(
        "file_id", "all", every(safe, SAFE_MODULE_ALIAS).alias("trusted"),
        F.array_except(F.concat(every(imports, XML_MODULE_ALIAS), every(imports, XML_NAME_ALIAS)), F.concat(*(every(safe, p) for p in SAFE_NAMES))).alias("aliases"),
    )
    used = lambda x, p, held: F.arrays_overlap(F.regexp_extract_all(x, F.lit(pat(p)), F.lit(1)), held)

    def kinds(x: Column, i: Column) -> Column:
        call = F.when(x.rlike(pat(XML_CALLS)), "unsafe_xml_call").when(used(x, rf"\b(\w+)\.(?:{XML_FUNCTIONS})\s*\(", F.col("aliases")), "alias_xml_call").when(used(x, r"(\w+)\s*\(", F.col("aliases")), "alias_func_call")
        fine = is_code(x) & ~x.rlike(pat(XML_SAFE)) & ~used(x, r"(\w+)\.", F.col("trusted"))
        return F.when(fine, F.struct((i + 1).alias("line_number"), F.array_compact(F.array(F.when(x.rlike(pat(XML_ENABLERS)), "explicit_enabler"), call)).alias("kinds")))

    lines = names.select("file_id", F.explode(F.filter(F.transform("all", kinds), lambda h: F.size(h["kinds"]) > 0)).alias("h"))
    rows = lines.select("file_id", "h.line_number", F.explode("h.kinds").alias("detection_type"))
    switch = F.col("detection_type") == "explicit_enabler"
    fixed = _finding("XXEDetector", "XML External Entity (XXE)", "HIGH", "CWE-611", 0.88)
    return rows.select("file_id", "line_number", *fixed[:2], F.when(switch, "CRITICAL").otherwise("HIGH").alias("severity"), fixed[3], F.when(switch, 0.97).otherwise(0.88).alias("confidence"), "detection_type")


def _ahead(files: DataFrame, guards: tuple[str, ...], n: int) -> DataFrame:
    """line_no, var and the n lines from each guard on; var is what the guard's group takes."""
    some = _with(files.filter("language = 'python'"), *guards).withColumn("all", F.split("code", "\n", -1))
    var = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, pat(p), 1), F.lit("")) for p in guards))
    heads = F.filter(F.transform("all", lambda x, i: F.when(var(x).isNotNull(), F.struct((i + 1).alias("line_no"), var(x).alias("var"), F.slice("all", i + 1, F.lit(n)).alias("ahead")))), lambda h: h.isNotNull())
    return some.select("file_id", F.inline(heads))


def encoded_paths(files: DataFrame) -> DataFrame:
    """The first use of a path within DOTS_LINES lines of a guard that only looks for `..`, where nothing decodes it."""
    sink = F.concat(F.lit(r"\b(?:open|os\.path\.join)\s*\(.*\b"), F.col("var"), F.lit(r"\b"))
    rows = _ahead(files, DOTS_GUARD, DOTS_LINES).filter(~F.array_join("ahead", "\n").rlike(pat(DOTS_DECODED)))
    at = F.array_position(F.transform("ahead", lambda x: F.regexp_like(x, sink)), True)
    rows = rows.withColumn("at", at).filter("at > 0")
    return rows.select("file_id", (F.col("line_no") + F.col("at") - 1).cast("int").alias("line_number"), *_finding(EVASION, "Path Traversal", "HIGH", "CWE-22", 0.93), F.col("var").alias("path_var"))


def quoted_shells(files: DataFrame) -> DataFrame:
    """The first shell command within QUOTED_LINES lines that takes a variable quoted for the shell."""
    system = F.concat(F.lit(r"\bos\.system\s*\(.*\b"), F.col("var"), F.lit(r"\b"))
    in_shell = lambda x: x.rlike(pat(SHELL_CALL)) & F.contains(x, F.lit("shell=True")) & F.array_contains(words(x), F.col("var"))
    at = F.array_position(F.transform("ahead", lambda x: F.regexp_like(x, system) | in_shell(x)), True)
    rows = _ahead(files, (QUOTED,), QUOTED_LINES).withColumn("at", at).filter("at > 0")
    return rows.select("file_id", (F.col("line_no") + F.col("at") - 1).cast("int").alias("line_number"), *_finding(EVASION, "Command Injection", "CRITICAL", "CWE-78", 0.95), F.col("var").alias("quoted_var"))


def _name(node: ast.AST) -> str:
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=attr):
            return f"{_name(value)}.{attr}".lstrip(".")
    return ""


def _gated_loads(code: str) -> list[int]:
    """The line of the first unsafe load under each `if` whose test speaks of a signature; none if the code doesn't parse."""
    try:
        tests = [n for n in ast.walk(ast.parse(code)) if isinstance(n, ast.If)]
        out = []
        for node in tests:
            said = " ".join(_name(x.func) if isinstance(x, ast.Call) else x.id for x in ast.walk(node.test) if isinstance(x, (ast.Call, ast.Name))).lower()
            if any(w in said for w in SIGNATURE_WORDS):
                out += [x.lineno for x in ast.walk(node) if isinstance(x, ast.Call) and _name(x.func) in UNSAFE_LOADS][:1]
        return out
    except (SyntaxError, ValueError, RecursionError):
        return []


def signed_loads(files: DataFrame) -> DataFrame:
    """Unsafe loads behind a check of a signature. Only files with such a call are parsed, in one narrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, line) for i, code in zip(frame["file_id"], frame["code"]) for line in _gated_loads(code)]
            yield pd.DataFrame(rows, columns=["file_id", "line_number"]).astype({"file_id": "Int64", "line_number": "Int32"})

    some = files.filter("language = 'python'").filter(F.col("code").rlike(r"(?:pickle|marshal)\s*\.\s*loads?|yaml\s*\.\s*load"))
    return some.select("file_id", "code").mapInPandas(run, "file_id long, line_number int").select("*", *_finding(EVASION, "Unsafe Deserialization", "CRITICAL", "CWE-502", 0.96))
