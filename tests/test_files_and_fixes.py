"""Folders read as files, fixes by line and laid over files, the whole scan."""

import hashlib

from pyspark.sql import functions as F

from lumenscan.operators import remediate as R
from lumenscan.operators import union as U
from lumenscan.sources.corpus import SNIPPETS, code_files
from lumenscan.sources.files import read_files


def test_read_files(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.py").write_bytes("x = 'é'\r\ny\rz\n".encode())
    (tmp_path / "deep" / "b.JS").write_bytes(b"caf\xe9")
    (tmp_path / "deep" / "c.ts").write_bytes(b"")
    (tmp_path / "big.go").write_bytes(b"x" * 101)
    (tmp_path / "venv" / "d.py").write_bytes(b"1")
    (tmp_path / "e.txt").write_bytes(b"1")
    files, rejected = read_files(spark, str(tmp_path), max_bytes=100)
    rows = {r.file_name: r for r in files.collect()}
    assert set(rows) == {"a.py", "b.JS"}
    assert rows["a.py"].code == "x = 'é'\ny\nz\n" and rows["a.py"].line_count == 4 and rows["a.py"].file_size_bytes == 14
    assert rows["a.py"].file_hash == hashlib.sha256(rows["a.py"].code.encode()).hexdigest()
    assert (rows["b.JS"].code, rows["b.JS"].language) == ("café", "javascript")
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in rejected.collect()} == {("big.go", "File too large")}
    assert {r.file_name for r in read_files(spark, str(tmp_path), recursive=False)[0].collect()} == {"a.py", "big.go"}
    assert [r.file_name for r in read_files(spark, str(tmp_path / "a.py"))[0].collect()] == ["a.py"]


FIXES = [
    ("Hardcoded Secret", '  my.key = "abc"  # x', '  my.key = os.environ.get("MY_KEY", "")  # x'),
    ("Hardcoded Secret", '  "api-key": "x"', None),
    ("Potential Hardcoded Secret", '  "api_key": "x",', '  "api_key": os.environ.get("API_KEY", ""),'),
    ("SQL Injection", 'cur.execute(f"SELECT 1 WHERE a=\'{x}\'")', 'cur.execute("SELECT 1 WHERE a=?", (x,))'),
    ("SQL Injection", '  q = f"SELECT {x}"', '  q = "SELECT ?"'),
    ("SQL Injection", 'q = "SELECT %s" % x', 'q = "SELECT ?"'),
    ("SQL Injection", "cur.execute(q)", None),
    ("Command Injection", "  os.system(cmd + x)", "  # Use list form: subprocess.run(['cmd', 'arg', user_var], shell=False)\n  subprocess.run([cmd + x], shell=False)  # MANUAL: replace with [executable, arg1, user_var]"),
    ("Command Injection", "subprocess.run(cmd, shell=True)", "subprocess.run(shlex.split(str(cmd)), shell=False)"),
    ("Code Execution", "data = eval(s)", "data = ast.literal_eval(s)"),
    ("Code Execution", "x = eval(s)", None),
    ("Weak Hash", "h = hashlib.md5(m + k.encode()).digest()", "h = hmac.new(k.encode(), m, hashlib.sha256).digest()"),
    ("Weak Hash", "h = hashlib.new('SHA1')", "h = hashlib.new('sha256'))"),  # the agreed rewrite keeps the call's own parenthesis
    ("Weak Random", "random.seed(1)", None),
    ("Weak Random", "x = random.choices(a, k=3)", "x = secrets.SystemRandom().choices(a, k=3)"),
    ("Weak Random", "    return ''.join(random.choices(a, k=6))", "    return secrets.token_hex(3)"),
    ("Debug Mode Enabled", "app.run(debug=True)", "app.run(debug=False)"),
    ("Unsafe Deserialization", "yaml.load(f, Loader=yaml.Loader)", "yaml.safe_load(f)"),
    ("Unsafe Deserialization", "pickle.loads(f)", None),
    ("Prompt Injection", '  p = f"Say {user}!"', '  _user_content = str(user)[:2000]  # length-limited\n  p = "Say " + _user_content + "!"'),
    ("Prompt Injection", "p = base + user_query", "_sanitized_input = str(user_query)[:2000]  # length-limited\np = base + _sanitized_input"),
    ("Prompt Injection", "p = base + other", None),
    ("Path Traversal", "open(p)", None),
    ("Debug Mode Enabled", "app.run()  # debug=True", None),
    ("Weak Hash", None, None),
]


def test_fixes_of_lines(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(FIXES)], "k int, kind string, line string")
    got = {r.k: r.fixed for r in rows.select("k", R.fix(F.col("kind"), F.col("line")).alias("fixed")).collect()}
    assert [(FIXES[k][1], got[k]) for k in range(len(FIXES))] == [(line, fixed) for _, line, fixed in FIXES]


def test_fixes_of_files(spark):
    code = "a = 1\nh = hashlib.md5(x)\n  p = f'Say {user}!'\napp.run(debug=True)"
    files = spark.createDataFrame([(1, code), (2, "x"), (3, None)], "file_id long, code string")
    found = [(1, 2, "Weak Hash", 4), (1, 2, "Weak Hash", 5), (1, 3, "Prompt Injection", 0), (1, 4, "Debug Mode Enabled", 9), (1, 4, "SQL Injection", 1), (1, 77, "Weak Hash", 1), (3, 1, "Weak Hash", 1)]
    fixed, diffs = R.apply_fixes(files, spark.createDataFrame(found, "file_id long, line_number int, vulnerability_type string, det_ord int"))
    want = "a = 1\nh = hashlib.sha256(x)\n  _user_content = str(user)[:2000]  # length-limited\n  p = 'Say ' + _user_content + '!'\napp.run(debug=False)"
    assert {r.file_id: r.code for r in fixed.collect()} == {1: want, 2: "x", 3: None}
    assert {(r.file_id, r.line_number) for r in diffs.collect()} == {(1, 2), (1, 3), (1, 4)}


def test_scan_has_every_part(spark):
    files = code_files(spark)
    every = U.all_findings(files).cache()
    held = {r.det_ord for r in every.select("det_ord").distinct().collect()}
    assert not [name for k, (name, _) in enumerate(U.PARTS) if k not in held]
    best = U.scan(files).groupBy("file_id", "line_number", F.lower("vulnerability_type")).count()
    assert best.filter("count > 1").count() == 0 and len(SNIPPETS) >= every.select("file_id").distinct().count() > 30
