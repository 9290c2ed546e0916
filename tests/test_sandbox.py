"""Fixes from paths and the reasons of statuses, by expectation. The queries compare the run and the overlays with SQL."""

import pytest
from pyspark.sql import functions as F

from lumenscan import catalog
from lumenscan.operators import sandbox, taint

FILES = "file_id long, path string, language string, code string"
FOUND = "file_id long, finding_id long, line_number int, vulnerability_type string"


@pytest.mark.parametrize("kind, line, source, at_sink, want", [
    ("SQL Injection", "  cursor.execute(q)", "uid", True, "  cursor.execute(q, (uid,))"),
    ("SQL Injection", "cursor.execute(q)  ", "uid", False, None),
    ("SQL Injection", 'cursor.execute(f"SELECT {x}")', "uid", True, 'cursor.execute("SELECT ?", (x,))'),
    ("Command Injection", "out = subprocess.run(cmd, shell=True) or 1", "p", True, "out = subprocess.run(['ls', '-la', p], shell=False) or 1"),
    ("Command Injection", "os.system('ls ' + p)", "request.args.get", True, "subprocess.run(['ls', '-la', request.args.get], shell=False)"),
    ("Command Injection", "os.system(f(p))", "p", True, "subprocess.run(['ls', '-la', p], shell=False))"),
    ("Command Injection", "subprocess.run(cmd, cwd=d, shell=True)", "p", True, "subprocess.run(shlex.split(str(cmd)), cwd=d, shell=False)"),
    ("Path Traversal", "open(p)", "p", True, None),
    ("Code Execution", "x = eval(p)", "p", True, None),
    (None, "open(p)", "p", True, None),
    ("SQL Injection", None, "p", True, None),
])
def test_fix_from_path(spark, kind, line, source, at_sink, want):
    df = spark.createDataFrame([(kind, line, source, at_sink)], "k string, l string, s string, a boolean")
    assert df.select(sandbox.fix_from_path(F.col("k"), F.col("l"), F.col("s"), F.col("a")).alias("x")).first().x == want




def test_fixes_of_paths_and_findings(spark):
    code = 'u = input()\nq = f"SELECT {u}"\ncursor.execute(q)\neval(u)\nrandom.seed(1)\nx = random.choices(a)\nh = hashlib.md5(b)'
    files = spark.createDataFrame([(1, "a.py", "python", code), (2, "b.py", "python", None), (3, "c.py", "python", "")], FILES)
    found = spark.createDataFrame([(1, 1, 5, "Weak Random"), (1, 2, 7, "Weak Hash"), (1, 3, 7, "Weak Hash"), (1, 4, 3, "SQL Injection"), (1, 5, 99, "Weak Hash"), (2, 6, 1, "Weak Hash")], FOUND)
    fixed, diffs = sandbox.fixes(files, sandbox.path_results(files), found)
    rows = {(r.line_number, r.fixed_line, r.is_functional) for r in diffs.collect()}
    assert rows == {(2, 'q = "SELECT ?"', True), (3, "cursor.execute(q, (input,))", True), (4, "eval(u)", False), (6, "x = secrets.SystemRandom().choices(a)", True), (7, "h = hashlib.sha256(b)", True)}
    assert {r.advice[:14] for r in diffs.collect() if not r.is_functional} == {"Replace eval()"}
    assert [(r.file_id, r.code.split("\n")[1]) for r in fixed.collect()] == [(1, 'q = "SELECT ?"')]


def test_targets(spark):
    code = 'u = input()\np = "a" + u\np = p + "b"\nopenai.Completion.create(p)\nopen(u)'
    files = spark.createDataFrame([(1, "a.py", "python", code)], FILES)
    got = {(r.vulnerability_type, r.line_number) for r in sandbox.targets(sandbox.path_results(files)).collect()}
    assert got == {("Prompt Injection", 2), ("Prompt Injection", 3), ("Path Traversal", 5)}


def test_reasons(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "u = input()\nopen(u)\nv = os.getenv('A')\nos.system(u)\neval(u)")], FILES)
    got = {r.sink_name: (r.reachability_status, r.reachability_reasoning, r.attack_path) for r in sandbox.path_results(files).collect()}
    assert got["open"] == ("Confirmed Reachable", "Tainted data flows from input (line 1) to open (line 2) with no sanitiser detected. The path is considered reachable.", "input:1 > u:1 > open:2")
    assert got["eval"][0] == "Requires Manual Review" and "(line 1) to sink (line 5) depends on runtime" in got["eval"][1]
    df = spark.createDataFrame([("Path Traversal", "u = 1\nos.path.basename(u)", False), ("SSRF", "u = 1\nget(u)", False), ("SSRF", "u = 1\nget(u)", True)], "k string, c string, ok boolean")
    status = taint.reach_status(F.col("k"), F.col("c"), F.lit(1), F.lit(2), F.col("ok"))
    rows = df.select(status["status"].alias("s"), taint.reasoning(status["status"], status["sanitizers"], F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("r")).collect()
    assert [r.s for r in rows] == ["Reachability Eliminated", "Unverifiable", "Confirmed Reachable"]
    assert rows[0].r.startswith("Sanitiser(s) detected between source (line 1) and sink (line 2): os.path.basename.") and rows[1].r.startswith("A potential path exists from a to b,")


def test_dedup_by_owner_and_status(spark):
    schema = "file_id long, line_number int, vulnerability_type string, detector_name string, confidence double, finding_id long, reachability_status string, sink_api string"
    rows = [(1, 1, "Weak Hash", "Other", 0.9, 1, "Confirmed Reachable", None), (1, 1, "weak hash", "WeakHashDetector", 0.1, 2, None, None), (1, 1, "Weak Hash", "Other", 0.9, 3, None, "eval"), (2, 1, "X", "A", 0.5, 1, None, None), (2, 1, "X", "B", 0.5, 2, None, None), (2, 1, "X", "C", 0.1, 3, "Unverifiable", None)]
    df = spark.createDataFrame(rows, schema)
    assert {(r.file_id, r.finding_id) for r in sandbox.dedup(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.file_id, r.finding_id) for r in sandbox.dedup(df, owners=False).collect()} == {(1, 1), (1, 3), (2, 3)}


def test_growing_sides_are_not_broadcast(spark):
    """Scratch files of repeated texts are small on disk, whatever their rows."""
    files = spark.createDataFrame([(1, "a.py", "python", "u = input()\nos.system(u)")], FILES)
    found = spark.createDataFrame([(1, 1, 2, "Command Injection", "HIGH", "", "D", 0.5, 1)], FOUND + ", severity string, cwe_id string, detector_name string, confidence double, det_ord int")
    results = sandbox.path_results(files)
    for rows in (results, *sandbox.fixes(files, results, found), sandbox.lay_last(found, results), sandbox.lay_missing(found, results), sandbox.lay_exclusive(found, results)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() > 0


def test_findings_and_results_are_dealt_once(spark):
    """Each was dealt anew for distinct rows, numbers, candidates, choices and what they change."""
    plan = catalog.queries()["lay_exclusive_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


def test_exclusive_results_of_odd_files(spark):
    """Files on one side only, without a number, with results that find nothing left, and with nulls."""
    found = [(1, 1, 5, "A"), (1, 2, 5, "b"), (1, 3, None, None), (2, 1, 7, "A"), (None, 9, 5, "A")]
    asked = [(1, 1, 5, [], 0, "B", True, "x"), (1, 2, 5, [None, 3], 0, "B", False, "y"), (1, 3, 5, [5], 5, "B", True, "z"), (1, 4, None, None, None, None, None, "n"), (3, 1, 8, [1], 2, "C", True, "w"), (None, 1, 5, [], 5, "A", True, "v")]
    extra = [F.lit(s).cast(k).alias(c) for c, k, s in (("severity", "string", "LOW"), ("cwe_id", "string", ""), ("detector_name", "string", "D"), ("confidence", "double", 0.5), ("det_ord", "int", 0))]
    f = spark.createDataFrame(found, FOUND).select("*", *extra)
    r = spark.createDataFrame(asked, "file_id long, result_id long, sink_line int, at array<int>, source_line int, vulnerability_type string, known boolean, sink_api string")
    r = r.select("*", F.transform("at", lambda x: F.struct(x.alias("line"))).alias("transforms"), F.lit("HIGH").alias("severity"), F.lit("C").alias("cwe_id"), *(F.lit(c).alias(c) for c in ("reachability_status", "reachability_reasoning", "attack_path"))).drop("at")
    rows = sandbox.lay_exclusive(f, r)
    assert rows.columns == [*f.columns, "reachability_status", "reachability_reasoning", "attack_path", "sink_api"]
    got = {(x.file_id, x.finding_id % (1 << 40), x.line_number, x.vulnerability_type, x.severity, x.cwe_id, x.detector_name, x.sink_api) for x in rows.collect()}
    alone = "StaticAnalysisPipeline"
    assert got == {
        (1, 2, 5, "B", "HIGH", "C", "D", "x"), (1, 1, 5, "A", "LOW", "", "D", "y"), (1, 3, None, None, "LOW", "", "D", None), (2, 1, 7, "A", "LOW", "", "D", None), (None, 9, 5, "A", "LOW", "", "D", None),
        (1, 3, 5, "B", "HIGH", "C", alone, "z"), (1, 4, None, None, "HIGH", "C", alone, "n"), (3, 1, 8, "C", "HIGH", "C", alone, "w"),
    }
    assert rows.count() == 8


def test_equal_texts_run_once(spark, monkeypatch):
    """Many orders make one text; the phases see it once, and all orders have what came of it."""
    seen, run = [], sandbox.run
    monkeypatch.setattr(sandbox, "run", lambda files: (seen.append(files), run(files))[1])
    out = catalog.queries()["sandbox_of_orders"](spark, "/root/testdata/sf0.001")
    codes = [r.code for r in seen[0].select("code").collect()]
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert len(codes) == len(set(codes)) < orders and out.select("file_id").distinct().count() == orders
