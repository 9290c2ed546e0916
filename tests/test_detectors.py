"""Detectors on the inline corpus, the taint closure against plain sweeps, deduplication against a tournament."""

import random
import re

from lumenscan.operators import detectors as D
from lumenscan.operators import injection as I
from lumenscan.operators import web as W
from lumenscan.sources.corpus import SNIPPETS, code_files
from lumenscan.sources.diffs import changed_lines


def found(spark, detector):
    return {(r.file_id, r.line_number, r.vulnerability_type) for r in D.detect(code_files(spark), detector).collect()}


def test_rules(spark):
    assert found(spark, D.WEAK_HASH) == {(4, 2, "Weak Hash"), (27, 1, "Weak Hash")}
    assert found(spark, D.SQL_FSTRING) == {(2, 1, "SQL Injection")}
    assert (8, 1, "Unsafe Deserialization") in found(spark, D.DESERIALIZATION) and not any(f[:2] == (8, 2) for f in found(spark, D.DESERIALIZATION))
    assert {f for f in found(spark, D.CRYPTO) if f[0] == 14} == {(14, 1, "Weak Key Size")}
    assert (24, 1, "Hardcoded Secret") in found(spark, D.SECRETS) and (25, 1, "Potential Hardcoded Secret") in found(spark, D.SECRETS)
    assert not any(f[:2] == (24, 2) for f in found(spark, D.SECRETS))


def test_reflection_and_guards(spark):
    """Blocklists count only in files that also reflect; spaces and following words in globals(); builtins; guards before setattr."""
    codes = ["blocked = ['os']\nm = __import__(name)", "blocked = ['os']\nx = 1", "f = globals ( ) [name + '_x']\ng = locals()['y']", "b = __builtins__.__dict__[n]\n# builtins.eval", "if hasattr(o, k):\n    setattr(o, 'a', v)", "if hasattr(o, k):\n    pass"]
    files = spark.createDataFrame([(k, f"f{k}.py", "python", c) for k, c in enumerate(codes)], "file_id long, path string, language string, code string")
    got = lambda d: {(r.file_id, r.line_number, r.vulnerability_type) for r in D.detect(files, d).collect()}
    assert got(D.REFLECTION) == {(0, 1, "Incomplete Blocklist"), (0, 2, "Unsafe Dynamic Import"), (2, 1, "Unsafe Reflection"), (3, 1, "Unsafe Reflection")}
    assert got(D.TYPE_CONFUSION) == {(4, 1, "Weak Attribute Guard")}


def test_static_ivs_by_their_surroundings(spark):
    iv = "iv = b'0123456789abcdef'"
    codes = [iv, iv + "\nc = algorithms.aes(k)", iv + "\n" * 5 + "aes", iv + "\nbase64.b64encode(x)\nencrypt(x)", iv + "\nbase64.b64encode(x)\nc = AES.new(k)", iv + "\nFernet(k)", iv + "\nb64decode(k)\nFernet(k)"]
    files = spark.createDataFrame([(k, f"f{k}.py", "python", c) for k, c in enumerate(codes)], "file_id long, path string, language string, code string")
    assert {r.file_id for r in D.detect(files, D.CRYPTO).collect() if r.vulnerability_type == "Static IV/Nonce"} == {1, 4, 6}
    imports = spark.createDataFrame([(0, "a.py", "python", "import Crypto.Cipher"), (1, "b.py", "python", "import Crypto.Cipher\nfrom Cryptodome import Random")], files.schema)
    assert {r.file_id for r in D.detect(imports, D.CRYPTO).collect()} == {0}


def test_seeds_equal_a_walk(spark):
    """Random programs: seeds of every kind, calls near and far below, words that suppress or overrule."""
    rng = random.Random(5)
    pool = ["random.seed(time.time())", "random.seed(int(x))", "random.seed(7)", "random.seed(str(k)); random.random()", "# random.seed(time.time())", "a = random.random()", "a = random.choice(b)", "x = 1", "", "demo = 1", "token = 1", "secrets.choice(random.random())", "// random.random()"]
    codes = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    want = []
    for k, code in enumerate(codes):
        text, last = code.split("\n"), None
        for n, line in enumerate(text, 1):
            if not line.strip() or line.startswith(("#", "//")) or "secrets." in line:
                continue
            if "random.seed(" in line:
                if "time." in line or "int(" in line or "str(" in line:
                    last = n
                    want.append((k, n, 0.93))
            elif "random.random(" in line or "random.choice(" in line:
                at = last if last is not None and n - last <= 3 else n
                around = " ".join(text[max(0, at - 8) : at + 3]).lower()
                if "demo" not in around or "token" in around or "secret" in around:
                    want.append((k, at, 0.92))
    files = spark.createDataFrame([(k, f"f{k}.py", "python", c) for k, c in enumerate(codes)], "file_id long, path string, language string, code string")
    got = sorted((r.file_id, r.line_number, r.confidence) for r in D.detect(files, D.WEAK_RANDOM).collect())
    assert got == sorted(want) and any(n != m for (_, n, c), (_, m, _) in zip(want, want[1:]) if c == 0.92)


def test_toctou_is_strict(spark):
    rows = {(r.file_id, r.line_number, r.check_line) for r in D.toctou(code_files(spark)).collect()}
    assert (10, 2, 1) in rows and not any(r[0] == 11 for r in rows)


def test_taint_equals_sweeps(spark):
    want = set()
    for k, (_, code) in enumerate(SNIPPETS, 1):
        lines = [x for x in code.split("\n") if x.strip() and not x.strip().startswith("#")]
        tainted = {m[1] for x in lines if (m := re.search(D.SOURCE, x))}
        for _ in range(D.SWEEPS):
            for x in lines:
                if (m := re.match(D.ASSIGN, x)) and tainted & set(re.findall(r"\w+", m[2])):
                    tainted.add(m[1])
        want |= {(k, v) for v in tainted}
    assert {(r.file_id, r.var) for r in D.tainted_variables(code_files(spark)).collect()} == want


def test_taint_follows_long_chains(spark):
    down = ["v0 = input()", *(f"v{k} = v{k - 1}" for k in range(1, 41))]
    up = [*(f"u{k} = u{k - 1}" for k in range(9, 0, -1)), "u0 = input()"]
    code = spark.createDataFrame([(1, "a.py", "python", "\n".join(down)), (2, "b.py", "python", "\n".join(up))], "file_id long, path string, language string, code string")
    got = {(r.file_id, r.var) for r in D.tainted_variables(code).collect()}
    assert got == {(1, f"v{k}") for k in range(41)} | {(2, f"u{k}") for k in range(D.SWEEPS + 1)}


def test_dedup_keeps_the_owner(spark):
    rows = [(1, 1, "OtherDetector", "Weak Hash", 0.99, 0), (1, 1, "WeakHashDetector", "Weak Hash", 0.5, 1), (1, 2, "A", "X", 0.5, 0), (1, 2, "B", "x", 0.5, 1)]
    df = spark.createDataFrame(rows, "file_id long, line_number int, detector_name string, vulnerability_type string, confidence double, det_ord int")
    assert {r.detector_name for r in D.dedup(df).collect()} == {"WeakHashDetector", "A"}


def test_diff(spark):
    text = "+++ b/x\n@@ -3,2 +5,3 @@\n a\n-b\n+c\n+d\n"
    assert {(r.path, r.line_no) for r in changed_lines(spark.createDataFrame([(1, text)], "diff_id long, text string")).collect()} == {("x", 6), ("x", 7)}


def test_sinks_near_taint(spark):
    rows = {(r.file_id, r.line_number, r.tainted_var) for r in I.near_taint(code_files(spark), I.XPATH).collect()}
    assert rows == {(31, 3, "bar"), (31, 4, "bar"), (34, 3, "new")}
    assert {(r.file_id, r.line_number, r.tainted_var) for r in I.near_taint(code_files(spark), I.LDAP).collect()} == {(32, 2, "ldap_filter"), (32, 4, "ldap_filter")}


def test_cookie_calls_span_lines(spark):
    assert {(r.file_id, r.line_number) for r in I.insecure_cookies(code_files(spark)).collect()} == {(9, 1), (35, 1), (35, 7)}


def test_web_handlers(spark):
    files = code_files(spark)
    at = lambda df: {(r.file_id, r.line_number) for r in df.collect()}
    assert at(W.missing_headers(files)) == {(36, 1), (37, 1)} and at(W.missing_csrf(files)) == {(36, 2)}
    assert at(W.line_rule(files, W.UPLOAD)) == {(37, 5)} and at(W.line_rule(files, W.DISCLOSURE)) == {(36, 7)}
    assert at(W.line_rule(files, W.RATE_LIMIT)) == {(36, 2), (38, 2)}
    assert at(I.near_taint(files, W.TRUST)) == {(12, 2), (39, 2), (39, 4), (61, 13)}


def test_prompts_and_agents(spark):
    files = code_files(spark)
    assert {(r.file_id, r.line_number) for r in W.prompt_lines(files).collect()} == {(40, 1), (41, 2)}
    rows = {(r.file_id, r.line_number, r.operation) for r in W.agent_operations(files).collect()}
    assert rows == {(42, 2, "os.remove"), (42, 51, "os.unlink"), (42, 54, "subprocess.popen"), (42, 54, "shell=true")} | {(57, 2, "os.remove"), (57, 2, "subprocess.run"), (57, 5, "shell=true"), (57, 6, "sudo"), (57, 8, "os.remove")}


def test_permission_configs(spark):
    """A restart loses the block before, an unclosed block swallows its lines, the closing line counts as outside."""
    got = {(r.line_number, r.vulnerability_type, r.dangers) for r in W.permission_configs(code_files(spark)).collect() if r.file_id == len(SNIPPETS) - 2}
    assert got == {(4, "Overly Permissive AI Config", "Delete Permission"), (8, "Dangerous Permission Setting", "Elevated Privileges"), (9, "Dangerous Permission Setting", "Elevated Privileges")}
    rows = [("config = {", '"exec": True', "def f(): # \"run\": True", "x"), ('config = {"exec": True}', "a", "}"), ('config = {"exec": True}',), ("x", '"run": True', "settings: {")]
    files = spark.createDataFrame([(k, "a.py", "python", "\n".join(r)) for k, r in enumerate(rows)] + [(9, "a", "python", None), (10, "a", "python", "")], "file_id long, path string, language string, code string")
    found = {(r.file_id, r.line_number, r.dangers) for r in W.permission_configs(files).collect()}
    assert found == {(0, 1, "Execute Permission"), (0, 3, "Execute Permission"), (1, 1, "Execute Permission"), (3, 2, "Execute Permission")}


def test_prompt_flow(spark):
    got = {(r.line_number, r.user_variable) for r in W.prompt_flow(code_files(spark)).collect() if r.file_id == len(SNIPPETS) - 1}
    assert got == {(3, "a"), (5, "b")}  # line 4 takes input anew, line 6 has no whole word
