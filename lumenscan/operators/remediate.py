"""Fixes of lines by the type of their finding, and files with the fixes applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grown

# The rewrites that results must agree on. That of NAMED_HASH closes a call which the line closes again.
SECRET = r"^(\s*)([\w.]+)\s*=\s*[\"'](.+?)[\"'](.*)$"
SECRET_ENTRY = r"^(\s*)[\"'](\w+)[\"']\s*:\s*[\"'](.+?)[\"'](.*)$"
SQL_CALL = r"^(.*?\.execute\s*\(\s*)f([\"'])(.*?)\{(\w+)\}(.*?)\2\s*\)(.*)$"
SQL_TEXT = r"(\w+)\s*=\s*f([\"'])(.*?)\{(\w+)\}(.*?)\2"
SQL_PERCENT = r"(\w+)\s*=\s*([\"'])(.*?)%s(.*?)\2\s*%\s*(\w+)"
SHELL_CALL = r"subprocess\.(run|call|check_output|Popen)\s*\(\s*([^,\)]+)\s*,"
SYSTEM_CALL = r"os\.system\s*\(\s*(.+?)\s*\)\s*$"
LITERAL_WORDS = "parse|literal|payload|config|json|data|value"
KEYED_HASH = r"hashlib\.(?:md5|sha1)\s*\(\s*(\w+)\s*\+\s*(\w+)\.encode\s*\(\s*\)\s*\)\.digest\s*\(\s*\)"
NAMED_HASH = r"hashlib\.new\s*\(\s*['\"]\w+['\"]"
JOINED_CHOICES = r"return\s+['\"]*\.join\s*\(\s*random\.choices\s*\([^)]+\)\s*\)"
YAML_LOADER = r"yaml\.load\s*\(\s*([^,]+),\s*Loader\s*=\s*\w+\.\w+\s*\)"
YAML_PLAIN = r"yaml\.load\s*\(\s*([^)]+)\s*\)"
PROMPT_TEXT = r"=\s*f([\"'])(.*?)\{(\w+)\}(.*?)\1"
PROMPT_SUM = r"=\s*(.+?)\s*\+\s*(\w+)\s*$"
PROMPT_WORDS = "(?i)user|input|query|message|data"


def _has(line: Column, text: str) -> Column:
    return F.contains(line, F.lit(text))


def _swap(line: Column, old: str, new: str) -> Column:
    return F.replace(line, F.lit(old), F.lit(new))


def _indent(line: Column) -> Column:
    return F.regexp_extract(line, r"^(\s*)", 1)


def _env(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9_]", "_")


def _unquoted(before: Column, after: Column) -> Column:
    return F.concat(F.regexp_replace(before, "['\"]$", ""), F.lit("?"), F.regexp_replace(after, "^['\"]", ""))


def fix_secret(line: Column) -> Column:
    a, b = (lambda k, p=p: F.regexp_extract(line, p, k) for p in (SECRET, SECRET_ENTRY))
    return F.when(line.rlike(SECRET), F.concat(a(1), a(2), F.lit(' = os.environ.get("'), _env(a(2)), F.lit('", "")'), a(4))).when(
        line.rlike(SECRET_ENTRY), F.concat(b(1), F.lit('"'), b(2), F.lit('": os.environ.get("'), _env(b(2)), F.lit('", "")'), b(4))
    )


def fix_sql(line: Column) -> Column:
    a, b, c = (lambda k, p=p: F.regexp_extract(line, p, k) for p in (SQL_CALL, SQL_TEXT, SQL_PERCENT))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return (
        F.when(line.rlike(SQL_CALL), F.concat(a(1), quoted(_unquoted(a(3), a(5))), F.lit(", ("), a(4), F.lit(",))"), a(6)))
        .when(line.rlike(SQL_TEXT), F.concat(_indent(line), b(1), F.lit(" = "), quoted(_unquoted(b(3), b(5)))))
        .when(line.rlike(SQL_PERCENT), F.concat(_indent(line), c(1), F.lit(" = "), quoted(F.concat(c(3), F.lit("?"), c(4)))))
    )


def fix_command(line: Column) -> Column:
    inner, indent = F.regexp_extract(F.btrim(line, F.lit(" \t\r\f")), SYSTEM_CALL, 1), _indent(line)
    note = F.concat(indent, F.lit("# Use list form: subprocess.run(['cmd', 'arg', user_var], shell=False)\n"))
    call = F.concat(note, indent, F.lit("subprocess.run(["), inner, F.lit("], shell=False)  # MANUAL: replace with [executable, arg1, user_var]"))
    split = F.regexp_replace(_swap(line, "shell=True", "shell=False"), SHELL_CALL, r"subprocess.$1(shlex.split(str($2)),")
    return F.when(_has(line, "os.system(") & (inner != ""), call).when(_has(line, "shell=True"), split)


def fix_evaluation(line: Column) -> Column:
    return F.when(_has(line, "eval(") & ~_has(line, "literal_eval") & F.lower(line).rlike(LITERAL_WORDS), _swap(line, "eval(", "ast.literal_eval("))


def fix_hash(line: Column) -> Column:
    named = F.lower(F.regexp_extract(line, r"hashlib\.new\s*\(\s*['\"](\w+)['\"]", 1)).isin("md5", "sha1")
    return (
        F.when(line.rlike(KEYED_HASH), F.regexp_replace(line, KEYED_HASH, r"hmac.new($2.encode(), $1, hashlib.sha256).digest()"))
        .when(_has(line, "hashlib.md5("), _swap(line, "hashlib.md5(", "hashlib.sha256("))
        .when(_has(line, "hashlib.sha1("), _swap(line, "hashlib.sha1(", "hashlib.sha256("))
        .when(named, F.regexp_replace(line, NAMED_HASH, "hashlib.new('sha256')"))
    )


def fix_random(line: Column) -> Column:
    return F.when(_has(line, "random.seed("), None).when(line.rlike(JOINED_CHOICES), F.regexp_replace(line, JOINED_CHOICES, "return secrets.token_hex(3)")).when(_has(line, "random.choices("), _swap(line, "random.choices(", "secrets.SystemRandom().choices("))


def fix_debug(line: Column) -> Column:
    return F.when(_has(line, "debug=True") & _has(line, "app.run"), _swap(line, "debug=True", "debug=False"))


def fix_yaml(line: Column) -> Column:
    loader = _has(line, "Loader=")
    return F.when(_has(line, "yaml.load("), F.when(loader, F.regexp_replace(line, YAML_LOADER, "yaml.safe_load($1)")).otherwise(F.regexp_replace(line, YAML_PLAIN, "yaml.safe_load($1)")))


def fix_prompt(line: Column) -> Column:
    """The user's part in a variable of limited length, on a line of its own. Templates of format() have no fix here."""
    a, c = (lambda k, p=p: F.regexp_extract(line, p, k) for p in (PROMPT_TEXT, PROMPT_SUM))
    indent, left = _indent(line), F.btrim(F.substring_index(line, "=", 1), F.lit(" \t"))
    limited = lambda name, var: F.concat(indent, F.lit(f"{name} = str("), var, F.lit(")[:2000]  # length-limited\n"), indent, left, F.lit(" = "))
    text = F.concat(limited("_user_content", a(3)), a(1), F.regexp_replace(a(2), r"[{}]", ""), a(1), F.lit(" + _user_content + "), a(1), a(4), a(1))
    return F.when(line.rlike(PROMPT_TEXT), text).when(line.rlike(PROMPT_SUM) & c(2).rlike(PROMPT_WORDS), F.concat(limited("_sanitized_input", c(2)), c(1), F.lit(" + _sanitized_input")))


#: Part of a type's name and its fix; the first part that a type holds decides.
STRATEGIES = (
    ("hardcoded secret", fix_secret), ("sql injection", fix_sql), ("command injection", fix_command), ("code execution", fix_evaluation), ("prompt injection", fix_prompt),
    ("weak hash", fix_hash), ("weak random", fix_random), ("debug mode enabled", fix_debug), ("unsafe deserialization", fix_yaml),
)


def without_comments(code: Column) -> Column:
    """Code without comments and outer white space, to tell whether a fix changes what runs."""
    kept = F.filter(F.split(code, "\n", -1), lambda x: ~F.startswith(F.ltrim(x, F.lit(" \t")), F.lit("#")))
    return F.btrim(F.array_join(F.transform(kept, lambda x: F.substring_index(x, "#", 1)), "\n"), F.lit(" \t\r\n"))


def fix(kind: Column, line: Column) -> Column:
    """The fixed line, of one or more lines; null where the type has no fix, it doesn't apply, or nothing that runs changes."""
    out = F.lit(None).cast("string")
    for part, one in reversed(STRATEGIES):
        out = F.when(F.contains(F.lower(kind), F.lit(part)), one(line)).otherwise(out)
    return F.when(without_comments(out) != without_comments(line), out)


def apply_fixes(files: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixed, diffs) of findings with file_id, line_number, vulnerability_type and det_ord.

    diffs: file_id, line_number, vulnerability_type, original_line, fixed_line; one for each line, by the first finding with a
    fix that applies. fixed: file_id, code. Files stay one row: fixes are joined by file and laid over its lines, so a fix of
    several lines moves no other. Files without fixes keep their code; null code stays null."""
    lined = files.select("file_id", F.split("code", "\n", -1).alias("all"))
    at = findings.select("file_id", "line_number", "vulnerability_type", "det_ord").join(grown(lined), "file_id")
    line = F.try_element_at("all", F.col("line_number"))
    tried = at.select("file_id", "line_number", "vulnerability_type", "det_ord", line.alias("original_line")).withColumn("fixed_line", fix(F.col("vulnerability_type"), F.col("original_line"))).filter("fixed_line is not null")
    first = Window.partitionBy("file_id", "line_number").orderBy("det_ord", "vulnerability_type", "fixed_line")
    diffs = tried.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank", "det_ord")
    laid = diffs.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("line_number", "fixed_line"))).alias("fixes"))
    rows = lined.join(grown(laid), "file_id", "left")
    code = F.array_join(F.transform("all", lambda x, i: F.coalesce(F.try_element_at("fixes", i + 1), x)), "\n")
    return rows.select("file_id", code.alias("code")), diffs


# What to do by hand, by part of the type's name; the first two also need the call on the line.
BY_HAND = (
    ("code execution", "eval", "Replace eval() with ast.literal_eval() for data parsing, or use a safe expression evaluator (e.g. simpleeval) for computation. Never pass user input directly to eval()."),
    ("code execution", "exec", "Eliminate exec() entirely. Map user actions to named handler functions via a dispatch dict instead of executing arbitrary strings."),
    ("pickle|deserialization", "", "Replace pickle.loads() with json.loads() or a schema-validated deserializer. If pickle is required, use hmac-signed payloads and restrict allowed classes via RestrictedUnpickler."),
    ("path traversal", "", "Resolve the path with os.path.realpath() then verify it starts with the allowed base directory using str.startswith(). Reject any path containing '..'."),
    ("xss|template injection", "", "Use html.escape() on all user-controlled values before inserting into HTML. Prefer render_template() with auto-escaping over render_template_string() with f-strings."),
    ("ssrf", "", "Validate URLs against an allowlist of permitted hosts/schemes. Block private/internal IP ranges (127.0.0.0/8, 10.0.0.0/8, 169.254.169.254) before making outbound requests."),
    ("redos", "", "Simplify the regex to avoid nested quantifiers. Use re2 or set a timeout with regex.match(pattern, string, timeout=N). Validate input length before regex matching."),
    ("open redirect", "", "Validate redirect target against a strict allowlist. Use url_has_allowed_host_and_scheme() or check that the URL starts with '/' and does not start with '//'."),
    ("command injection", "", "Use subprocess.run([cmd, arg1, arg2], shell=False) with an explicit argument list. Never interpolate user input into command strings."),
    ("sql injection", "", "Use parameterized queries: cursor.execute('SELECT * FROM users WHERE id = ?', (user_id,)). Never use f-strings or string concatenation for SQL."),
)


def by_hand(kind: Column, line: Column) -> Column:
    """Advice for findings without a fix."""
    out = F.concat(F.lit("Review this "), kind, F.lit(" finding manually. Apply input validation, use safe API alternatives, and enforce least-privilege access."))
    for part, call, text in reversed(BY_HAND):
        out = F.when(F.lower(kind).rlike(part) & F.contains(line, F.lit(call)), text).otherwise(out)
    return out
