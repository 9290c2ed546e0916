"""Detectors as rule tables: each line gets the first rule that matches, in one narrow projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_in, frame, is_code, lines, pat
from ..sources.warehouse import written


@dataclass(frozen=True)
class Rule:
    pattern: str
    vulnerability_type: str
    severity: str
    cwe_id: str
    sql: str | None = None  # the pattern without lookarounds, for engines that lack them
    context: tuple[str, int, int] | None = None  # must match in the frame (pattern, lines before, lines after)
    skip: tuple[str, int, int] | None = None  # must not match there
    despite: str | None = None  # matching in the frame of `skip`, it overrules that
    file: str | None = None  # must match in the file
    unless: str | None = None  # must not match in the file
    needs: tuple[str, ...] | str = ()  # texts of which every match holds one, or a part of the pattern that begins with a fixed character


@dataclass(frozen=True)
class Detector:
    name: str
    confidence: float
    rules: tuple[Rule, ...]
    file: str | None = None
    safe: str | None = None  # a line with it is never reported
    slashes: bool = False  # lines that begin with // are comments too
    needs: tuple[str, ...] = ()  # as of rules, for those without their own and for seeds
    seeds: tuple[str, str, float] | None = None  # calls that seed, what makes a seed predictable, and its confidence


# The patterns, types, severities and CWE numbers that results must agree on.
_ITEMS = r"for\s+\w+(?:\s*,\s*\w+)?\s+in\s+\w+\.items\(\)"
_SEEDS = (r"\brandom\.seed\s*\(", r"time\.|datetime|os\.getpid|int\s*\(|str\s*\(", 0.93)
SEED_REACH = 3  # a finding so many lines below a predictable seed is reported at the seed
_IV = r"(?:iv|nonce|IV|NONCE)\s*=\s*(?:b?['\"][^'\"]{8,}['\"])"
_QUOTED_VALUE = r"=\s*b?['\"][^'\"]{8}"
_BASE64 = "(?i)base64|b64encode|b64decode|urlsafe_b64|encodebytes"
DESERIALIZATION = Detector("DeserializationDetector", 0.92, tuple(Rule(rf"\b{p}\s*\(", "Unsafe Deserialization", "CRITICAL", "CWE-502") for p in (r"pickle\.loads?", r"cPickle\.loads?", r"marshal\.loads?", r"shelve\.open", r"yaml\.load", r"yaml\.unsafe_load", r"jsonpickle\.decode", r"dill\.loads?")), needs=("ickle.", "marshal.", "shelve.", "yaml.", "dill."), safe=r"(?i)yaml\.safe_load|yaml\.CSafeLoader|SafeLoader|defusedxml|ast\.literal_eval")
CRYPTO = Detector("CryptoMisuseDetector", 0.92, (
    Rule(_IV, "Static IV/Nonce", "HIGH", "CWE-329", context=("(?i)aes|cipher|encrypt|decrypt|mode_|gcm|cbc|ctr|chacha", 3, 4), skip=(_BASE64, 3, 4), despite=r"(?i)aes\.new|cipher\.new|cipher\.encrypt|fernet|mode_cbc|mode_gcm|mode_ctr|chacha20", needs=_QUOTED_VALUE),
    Rule(_IV, "Static IV/Nonce", "HIGH", "CWE-329", context=("(?i)fernet", 3, 4), skip=("", 3, 4), despite=_BASE64, needs=_QUOTED_VALUE),  # counts beside base64 only
    Rule(r"MODE_ECB|modes\.ECB|(?<!\w)ECB\s*\(", "ECB Mode Usage", "HIGH", "CWE-327", sql=r"MODE_ECB|modes\.ECB|(?:^|[^\w])ECB\s*\(", needs=("ECB",)),
    Rule(r"(?:Cipher|algorithms)\s*\.\s*(?:DES|DES3|TripleDES|Blowfish|ARC2|ARC4|RC4|XOR|IDEA|CAST5|SEED)\s*[\.(]", "Weak Cipher Algorithm", "HIGH", "CWE-327", needs=("Cipher", "algorithms")),
    Rule(r"(?:AES|DES|Cipher)\.new\s*\(\s*b?['\"][^'\"]{8,}['\"]", "Hardcoded Encryption Key", "CRITICAL", "CWE-321", needs=(".new",)),
    Rule(r"(?:generate_private_key|RSA\.generate|DSA\.generate)\s*\(\s*(?:key_size\s*=\s*)?(?:\d{1,3}|1\d{3}|20[0-3]\d|204[0-7])\D", "Weak Key Size", "HIGH", "CWE-326", needs=("generate",)),
    Rule(r"(?:Crypto|Cryptodome)\.Hash\.(?:MD2|MD4|MD5|SHA)\b", "Weak Hash Algorithm", "HIGH", "CWE-327", needs=(".Hash.",)),
    Rule(r"hashes\.(?:MD5|SHA1)\s*\(", "Weak Hash Algorithm", "HIGH", "CWE-327", needs=("hashes.",)),
    Rule(r"from\s+Crypto\s+import|import\s+Crypto\.", "Deprecated Crypto Library", "MEDIUM", "CWE-327", unless=r"from\s+Cryptodome|import\s+Cryptodome", needs=("Crypto",)),
))
MEMORY = Detector("MemorySafetyDetector", 0.88, (
    Rule(r"ctypes\.CDLL\s*\(\s*None\s*\)", "Unsafe C Library Access", "HIGH", "CWE-119"),
    Rule(r"(?:libc|cdll|lib)\w*\.(?:memcpy|memmove|memset|strcpy|strcat|sprintf)\s*\(", "Unsafe Memory Operation", "CRITICAL", "CWE-120", needs=(".mem", ".str", ".sprintf")),
    Rule(r"ctypes\.cast\s*\([^,]+,\s*ctypes\.(?:POINTER|c_void_p|c_char_p)", "Unsafe Pointer Cast", "HIGH", "CWE-843"),
    Rule(r"ctypes\.(?:string_at|wstring_at)\s*\(\s*\w+\s*,\s*(?!\d)\w+", "Unsafe Memory Read", "HIGH", "CWE-125", sql=r"ctypes\.(?:string_at|wstring_at)\s*\(\s*\w+\s*,\s*[A-Za-z_]\w*"),
    Rule(r"marshal\.loads?\s*\(", "Unsafe Marshal Deserialization", "HIGH", "CWE-502"),
    Rule(r"ctypes\.(?:pointer|addressof|byref)\s*\(", "Low-Level Memory Access", "MEDIUM", "CWE-119"),
), file="ctypes|marshal", needs=("ctypes", "marshal"))
TYPE_CONFUSION = Detector("TypeConfusionDetector", 0.88, (
    Rule(r"setattr\s*\(\s*\w+\s*,\s*\w+\s*,\s*\w+\s*\)", "Mass Assignment", "HIGH", "CWE-915", context=(_ITEMS, 2, 12)),
    Rule(r"__dict__\s*\.update\s*\(\s*(?![\{'\"])\w+", "Mass Assignment", "HIGH", "CWE-915", sql=r"__dict__\s*\.update\s*\(\s*\w+"),
    Rule(r"def\s+\w*merge\w*\s*\(", "Prototype Pollution", "HIGH", "CWE-1321", context=(r"for\s+\w+\s*,\s*\w+\s+in\s+\w+\.items\(\)", 2, 12)),
    Rule(r"def\s+__reduce__\s*\(\s*self\s*\)", "Pickle Exploitation Enabler", "MEDIUM", "CWE-502", needs=("__reduce__",)),
    Rule(r"if\s+hasattr\s*\(\s*\w+\s*,\s*\w+\s*\)\s*:", "Weak Attribute Guard", "MEDIUM", "CWE-915", context=(r"setattr\s*\(", 2, 12)),
), needs=("attr", "__dict__", "merge"))
REFLECTION = Detector("UnsafeReflectionDetector", 0.90, (
    Rule(r"eval\s*\(\s*\w+\s*,\s*\{[^}]*__builtins__", "Server-Side Template Injection", "CRITICAL", "CWE-1336"),
    Rule(r"(?:blocked|blacklist|blocklist|deny)\s*=\s*\[.*?\]", "Incomplete Blocklist", "HIGH", "CWE-184", file="__import__|importlib|getattr", needs=r"=\s*\["),
    Rule(r"__import__\s*\(\s*(?!['\"])\w+", "Unsafe Dynamic Import", "CRITICAL", "CWE-470", sql=r"__import__\s*\(\s*\w+"),
    Rule(r"importlib\.import_module\s*\(\s*(?!['\"])\w+", "Unsafe Dynamic Import", "HIGH", "CWE-470", sql=r"importlib\.import_module\s*\(\s*\w+"),
    Rule(r"getattr\s*\(\s*\w+\s*,\s*(?!['\"])\w+", "Unsafe Reflection", "HIGH", "CWE-470", sql=r"getattr\s*\(\s*\w+\s*,\s*\w+"),
    Rule(r"setattr\s*\(\s*\w+\s*,\s*(?!['\"])\w+", "Attribute Injection", "HIGH", "CWE-915", sql=r"setattr\s*\(\s*\w+\s*,\s*\w+", skip=(_ITEMS, 3, 2)),
    Rule(r"(?:globals|locals)\s*\(\s*\)\s*\[\s*\w+", "Unsafe Reflection", "CRITICAL", "CWE-470"),
    Rule(r"(?:builtins|__builtins__)\s*(?:\.__dict__\s*\[|\.)\s*\w+", "Unsafe Reflection", "CRITICAL", "CWE-470"),
), needs=("builtins", "__import__", "import_module", "attr", "globals", "locals"))
WEAK_HASH = Detector("WeakHashDetector", 0.93, (
    Rule(r"hashlib\.new\s*\(\s*['\"](?:md5|sha1|sha|md4|md2|ripemd160)['\"]|hashlib\.(?:md5|sha1|sha|md4|md2|ripemd160)\s*\(", "Weak Hash", "HIGH", "CWE-328", skip=(r"(?i)checksum|dedup|file_id|etag|non-crypto|non-security|cache_key|content_hash|blob_id", 5, 2)),
), slashes=True, needs=("hashlib.",))
WEAK_RANDOM = Detector("WeakRandomDetector", 0.92, (
    Rule(r"\brandom\.(?:random|randint|randrange|uniform|choice|choices|sample|shuffle|gauss|normalvariate|lognormvariate|expovariate|vonmisesvariate|gammavariate|betavariate|paretovariate|weibullvariate|triangular|getrandbits|randbytes)\s*\(", "Weak Random", "HIGH", "CWE-330", skip=(r"(?i)shuffle|sample|demo|game|random_order|pick_random", 7, 3), despite=r"(?i)token|password|secret|key|session|auth|nonce|otp|csrf"),
), safe=r"(?i)secrets\.|SystemRandom\(\)|os\.urandom|random\.SystemRandom", slashes=True, needs=("random.",), seeds=_SEEDS)
SQL_FSTRING = Detector("SQLInjectionDetector", 0.92, (Rule(r"\.(?:execute|executemany)\s*\(\s*f['\"]", "SQL Injection", "CRITICAL", "CWE-89"),), needs=(".execute",), safe=r"\.(?:execute|executemany)\s*\([^,]+,\s*[\(\[]")
# Own specification: a credential's name with a quoted literal, else a literal with a known prefix.
SECRETS = Detector("HardcodedSecretsDetector", 0.95, (
    Rule(r"(?i)(?:api_?key|secret_?key|secret|password|passwd|token|aws_access_key|openai_api_key)[\"']?\s*[:=]\s*[\"'][^\"']{8,}[\"']", "Hardcoded Secret", "CRITICAL", "CWE-798", needs=r"[:=]\s*[\"'][^\"']{8}"),
    Rule(r"[\"'](?:sk-[A-Za-z0-9-]{20,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[bap]-[A-Za-z0-9-]{10,})[\"']", "Potential Hardcoded Secret", "HIGH", "CWE-798", needs=("sk-", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxa-", "xoxp-")),
))
DEBUG = Detector("OperationalSecurityDetector", 0.95, (Rule(r"\.run\s*\([^)]*debug\s*=\s*True", "Debug Mode Enabled", "HIGH", "CWE-489"),), needs=("debug",))
TEMP_FILE = Detector("TOCTOUDetector", 0.95, (Rule(r"tempfile\.mktemp\s*\(", "Insecure Temp File", "HIGH", "CWE-377"),), needs=("tempfile.",))

ALL = (SECRETS, WEAK_RANDOM, WEAK_HASH, SQL_FSTRING, DESERIALIZATION, REFLECTION, CRYPTO, TEMP_FILE, MEMORY, TYPE_CONFUSION, DEBUG)


def needed(needs: tuple[str, ...] | str) -> Column:
    """Whether the text holds what a match needs: far cheaper than the pattern itself."""
    if isinstance(needs, str):
        return F.col("code").rlike(pat(needs))
    return reduce(lambda a, b: a | b, (F.contains("code", F.lit(n)) for n in needs))


def gate(detector: Detector) -> Column:
    """Whether a file may hold a finding. A line that matches makes its file match."""
    patterns = {r.pattern: r.needs or detector.needs for r in detector.rules}
    if detector.seeds:
        patterns[detector.seeds[0]] = detector.needs
    held = reduce(lambda a, b: a | b, (needed(n) & F.col("code").rlike("(?m)" + pat(p)) for p, n in patterns.items()))
    return needed(detector.needs) & F.col("code").rlike(pat(detector.file)) & held if detector.file else held


def detect(files: DataFrame, detector: Detector) -> DataFrame:
    """Findings of one detector: file_id, line_number, detector_name, vulnerability_type, severity, cwe_id, confidence.

    With seeds, a line that seeds is judged by its seed alone; below the last predictable one, the first rule's findings stand on the
    seed's line and are suppressed by its surroundings."""
    some = files.filter(gate(detector))  # before lines are made
    gates = {f"_file{k}": F.col("code").rlike(pat(r.file)) for k, r in enumerate(detector.rules) if r.file}
    gates |= {f"_unless{k}": F.col("code").rlike(pat(r.unless)) for k, r in enumerate(detector.rules) if r.unless}
    rows = lines(some.withColumns(gates) if gates else some, *gates)
    clean = is_code(F.col("line"), detector.slashes)
    if detector.safe:
        clean &= ~F.col("line").rlike(pat(detector.safe))
    tests: list[Column] = []
    seeded = predictable = None
    for k, r in enumerate(detector.rules):
        test = F.col("line").rlike(pat(r.pattern))
        if r.file:
            test &= F.col(f"_file{k}")
        if r.unless:
            test &= ~F.col(f"_unless{k}")
        if r.context:
            rows = rows.withColumn(f"_context{k}", any_in(F.col("line").rlike(pat(r.context[0])), *r.context[1:]))
            test &= F.col(f"_context{k}")
        if r.skip:
            skip = any_in(F.col("line").rlike(pat(r.skip[0])), *r.skip[1:])
            if r.despite:
                skip &= ~any_in(F.col("line").rlike(pat(r.despite)), *r.skip[1:])
            rows = rows.withColumn(f"_skip{k}", skip)
            if detector.seeds and not k:
                seeded = F.col("line").rlike(pat(detector.seeds[0]))
                predictable = seeded & F.col("line").rlike(pat(detector.seeds[1]))
                above = F.last(F.when(clean & predictable, F.struct("line_no", F.col("_skip0").alias("skip"))), True).over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
                rows = rows.withColumn("_seed", above).withColumn("_seed", F.when(F.col("line_no") - F.col("_seed.line_no") <= SEED_REACH, F.col("_seed")))
                test &= ~F.coalesce(F.col("_seed.skip"), F.col("_skip0"))
            else:
                test &= ~F.col(f"_skip{k}")
        tests.append(test)
    kind = lambda r: F.struct(F.lit(r.vulnerability_type).alias("vulnerability_type"), F.lit(r.severity).alias("severity"), F.lit(r.cwe_id).alias("cwe_id"))
    hit = F.coalesce(*(F.when(t, kind(r)) for t, r in zip(tests, detector.rules)))
    at, sure = F.col("line_no"), F.lit(detector.confidence)
    if detector.seeds:
        hit = F.when(seeded, F.when(predictable, kind(detector.rules[0]))).otherwise(hit)
        at, sure = F.coalesce(F.col("_seed.line_no"), at), F.when(seeded, detector.seeds[2]).otherwise(sure)
    return rows.filter(clean).withColumn("hit", hit).filter("hit is not null").select("file_id", at.alias("line_number"), F.lit(detector.name).alias("detector_name"), "hit.*", sure.alias("confidence"))


def detect_sql(files: str, detector: Detector) -> str:
    """The same findings in SQL (RE2 patterns), for checking."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    like = lambda c, p: f"regexp_matches({c}, {q(p)})"
    w = lambda a, b: f"OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    extra, cases = [], []
    for k, r in enumerate(detector.rules):
        test = like("line", r.sql or r.pattern)
        for name, spec, sign in (("context", r.context, ""), ("skip", r.skip, "NOT ")):
            if spec:
                despite = f" AND NOT bool_or({like('line', r.despite)}) {w(*spec[1:])}" if name == "skip" and r.despite else ""
                extra.append(f"(bool_or({like('line', spec[0])}) {w(*spec[1:])}{despite}) AS {name}{k}")
                here = f"(CASE WHEN line_no - seed // 2 <= {SEED_REACH} THEN seed % 2 = 1 ELSE skip0 END)" if detector.seeds and f"{name}{k}" == "skip0" else f"{name}{k}"
                test += f" AND {sign}{here}"
        if r.file:
            test += f" AND file{k}"
        if r.unless:
            test += f" AND NOT unless{k}"
        cases.append(f"WHEN {test} THEN {k}")
    pick = lambda f: "CASE rule " + " ".join(f"WHEN {k} THEN {q(getattr(r, f))}" for k, r in enumerate(detector.rules)) + " END"
    where = f"WHERE {like('code', detector.file)}" if detector.file else ""
    tested = [(f"{name}{k}", p) for k, r in enumerate(detector.rules) for name, p in (("file", r.file), ("unless", r.unless)) if p]
    kept = "".join(f", {name}" for name, _ in tested)
    gates = "".join(f", {like('code', p)} AS {name}" for name, p in tested)
    safe = f"AND NOT {like('line', detector.safe)}" if detector.safe else ""
    if detector.slashes:
        safe += " AND NOT starts_with(trim(line, ' ' || chr(9) || chr(13) || chr(12)), '//')"
    trimmed = "trim(line, ' ' || chr(9) || chr(13) || chr(12))"
    clean = f"{trimmed} <> '' AND NOT starts_with({trimmed}, '#') {safe}"
    framed = f"""SELECT *{"".join(", " + e for e in extra)} FROM (
      SELECT file_id{kept}, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT file_id, string_split(code, chr(10)) AS p{gates} FROM ({files}) {where}))"""
    at, sure = "line_no", str(detector.confidence)
    if detector.seeds:
        # the last predictable seed above and, in the lowest bit, whether its surroundings suppress
        call, derived = (like("line", p) for p in detector.seeds[:2])
        framed = f"SELECT *, max(CASE WHEN {clean} AND {call} AND {derived} THEN line_no * 2 + CAST(skip0 AS INTEGER) END) {w('UNBOUNDED', 0)} AS seed FROM ({framed})"
        cases.insert(0, f"WHEN {call} THEN CASE WHEN {derived} THEN 0 END")
        at, sure = f"CASE WHEN line_no - seed // 2 <= {SEED_REACH} THEN seed // 2 ELSE line_no END", f"CASE WHEN {call} THEN {detector.seeds[2]} ELSE {sure} END"
    return f"""SELECT file_id, CAST({at} AS INTEGER) AS line_number, {q(detector.name)} AS detector_name, {pick("vulnerability_type")} AS vulnerability_type,
    {pick("severity")} AS severity, {pick("cwe_id")} AS cwe_id, CAST({sure} AS DOUBLE) AS confidence FROM (
    SELECT *, CASE {" ".join(cases)} END AS rule FROM ({framed})
    WHERE {clean}) WHERE rule IS NOT NULL"""


def detect_all(files: DataFrame) -> DataFrame:
    """The union of all detectors, with det_ord, the order of registration. The texts are read once; files that may hold a finding are
    written, and each detector reads those."""
    files, out = written(files.filter(reduce(lambda a, b: a | b, map(gate, ALL))), "candidates"), None
    for k, d in enumerate(ALL):
        part = detect(files, d).withColumn("det_ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


# Check and use calls of the time-of-check rule.
CHECK_CALL = r"(?:os\.path\.exists|os\.path\.isfile|os\.path\.isdir|os\.access|os\.stat|os\.lstat)\s*\(\s*(\w+)"
USE_CALL = r"(?:open|codecs\.open|os\.remove|os\.unlink|os\.rename|os\.chmod|os\.chown|shutil\.rmtree|shutil\.copy|shutil\.move)\s*\(\s*(\w+)"


def checks() -> Column:
    """Whether a file has a check."""
    return F.contains("code", F.lit("os.")) & F.col("code").rlike(pat(CHECK_CALL))


def toctou(files: DataFrame) -> DataFrame:
    """As-of join: the latest check of a variable strictly before its use, by one window over the events of each variable."""
    rows = lines(files.filter(checks())).filter(is_code(F.col("line")))
    event = lambda pattern, kind: F.when(F.col("line").rlike(pat(pattern)), F.struct(F.regexp_extract("line", pat(pattern), 1).alias("var"), F.lit(kind).alias("kind")))
    events = rows.select("file_id", "line_no", F.explode(F.array_compact(F.array(event(CHECK_CALL, "check"), event(USE_CALL, "use")))).alias("e")).select("file_id", "line_no", "e.*")
    before = Window.partitionBy("file_id", "var").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("check_line", F.max(F.when(F.col("kind") == "check", F.col("line_no"))).over(before))
    return found.filter("kind = 'use' and check_line is not null").select("file_id", F.col("line_no").alias("line_number"), "var", "check_line")


# How a variable gets user input.
SOURCE = r"(\w+)\s*=\s*(?:request\.(?:cookies|form|args|json|headers|data)(?:\.get(?:list)?)?|input\s*\(|params\[|sys\.argv|get\(|post\s*\()"
ASSIGN = r"^\s*(\w+)\s*=\s*(.*)"
SWEEPS = 3


def tainted_variables(files: DataFrame, source: str = SOURCE, comments: bool = False) -> DataFrame:
    """file_id, var: what user input reaches in three sweeps over the assignments.

    A file's assignments are collected by line and folded from the top, SWEEPS times, so a chain of any length further down
    is followed within one sweep and an assignment above fires in the next. One shuffle by file, no rounds of joins."""
    rows = lines(files) if comments else lines(files).filter(is_code(F.col("line")))
    seed = F.when(F.col("line").rlike(pat(source)), F.regexp_extract("line", pat(source), 1))
    edge = F.struct("line_no", F.regexp_extract("line", pat(ASSIGN), 1).alias("target"), F.array_distinct(F.regexp_extract_all(F.regexp_extract("line", pat(ASSIGN), 2), F.lit(pat(r"(\w+)")), 1)).alias("words"))
    by_file = rows.groupBy("file_id").agg(F.collect_set(seed).alias("vars"), F.array_sort(F.collect_list(F.when(F.col("line").rlike(pat(ASSIGN)), edge))).alias("edges"))
    state = by_file.filter(F.size("vars") > 0)
    for _ in range(SWEEPS):
        fire = lambda held, e: F.when(F.arrays_overlap(held, e["words"]), F.array_union(held, F.array(e["target"]))).otherwise(held)
        state = state.select("file_id", "edges", F.aggregate("edges", F.col("vars"), fire).alias("vars"))
    return state.select("file_id", F.explode("vars").alias("var"))


# The detector that owns each type.
_OWNERS = {"weak hash": "WeakHashDetector", "unsafe deserialization": "DeserializationDetector", "mass assignment": "TypeConfusionDetector", "attribute injection": "TypeConfusionDetector", "unsafe reflection": "UnsafeReflectionDetector", "hardcoded secret": "HardcodedSecretsDetector", "debug mode enabled": "OperationalSecurityDetector", "insecure temp file": "TOCTOUDetector", "weak random": "WeakRandomDetector"}


def dedup(findings: DataFrame) -> DataFrame:
    """The best finding of each (file, line, type): its owner's, then the surest, then the first."""
    kind = F.lower("vulnerability_type")
    kind = F.when(kind == "attribute injection", "mass assignment").otherwise(kind)
    owner = F.create_map(*(F.lit(x) for pair in _OWNERS.items() for x in pair))
    owned = F.coalesce(F.try_element_at(owner, F.lower("vulnerability_type")) == F.col("detector_name"), F.lit(False))
    best = Window.partitionBy("file_id", "line_number", "_key").orderBy(F.desc("_owned"), F.desc("confidence"), "det_ord")
    return findings.withColumns({"_key": kind, "_owned": owned}).withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_key", "_owned", "_rank")


__all__ = ["ALL", "Detector", "Rule", "dedup", "detect", "detect_all", "detect_sql", "frame", "tainted_variables", "toctou"]
