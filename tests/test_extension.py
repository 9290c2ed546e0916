"""A user's own detector and rules, and replies' texts against the standard library."""

import random
import textwrap

from pyspark.sql import functions as F

from lumenscan.functions import replies
from lumenscan.operators import extension
from lumenscan.plans.flows import verdict


def test_own_detector(spark):
    class Shouts:
        def eval(self, code, language, path):
            for k, line in enumerate((code or "").split("\n"), 1):
                if line.isupper():
                    yield k, f"Shout in {path}", "LOW", "CWE-1", 0.25

    files = spark.createDataFrame([(1, "a", "python", "x\nLOUD\n\nAGAIN"), (2, "b", "java", "LOUD"), (3, "c", None, None), (4, "d", "python", "")], "file_id long, path string, language string, code string")
    got = {tuple(r) for r in extension.detect_with(files, "Shouts", Shouts).collect()}
    assert got == {(f, n, "Shouts", f"Shout in {p}", "LOW", "CWE-1", 0.25) for f, n, p in ((1, 2, "a"), (1, 4, "a"), (2, 1, "b"))}
    assert {r.file_id for r in extension.detect_with(files, "Shouts", Shouts, "python").collect()} == {1}


def test_switched_off(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "h = hashlib.md5(x)\napp.run(debug=True)")], "file_id long, path string, language string, code string")
    names = {part: part == "det_ops_debug" for part, _ in extension.PARTS}
    assert {r.vulnerability_type for r in extension.enabled_findings(files, names).collect()} == {"Debug Mode Enabled"}


def test_own_rules_stand_last(spark):
    c = {k: F.lit(v) for k, v in {"kind": "Weak Hash", "line": "x", "code": "x", "path": "a.py"}.items()}
    none = F.lit(None).cast("string")
    of = lambda reach, *extra: verdict(c["kind"], c["line"], c["code"], c["path"], reach, F.lit(False), F.lit(True), extra)["reason"]
    yes, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        of(none).alias("a"), of(none, (yes, "Unverified", "one"), (yes, "Unverified", "two")).alias("b"), of(none, (yes, "Unverified", "one"), (yes, "Confirmed", "two"), (yes, "Out-of-scope", "three")).alias("c"),
        of(F.lit("Confirmed Reachable"), (yes, "Out-of-scope", "one")).alias("d"), of(none, (no, "Confirmed", "one"), (F.lit(None).cast("boolean"), "Confirmed", "two")).alias("e"),
    ).first()
    assert tuple(row) == ("Static match only; no verified data flow.", "two", "two", "Verified attack path from source to sink.", "Static match only; no verified data flow.")


def test_wrap_equals_textwrap(spark):
    r = random.Random(3)
    texts = ["", " ", "  lead", "x" * 50, "a\tb\nc  d ", "one " + "y" * 30 + " two"] + ["".join(r.choice(["a", "bb", "ccc-ddd", " ", "  ", "\n", "é", "long" * 6]) for _ in range(r.randrange(60))) for _ in range(120)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {x.k: x.w for x in frame.select("k", replies.wrap(F.col("t"), 20).alias("w")).collect()}
    assert got == {k: textwrap.fill(t, 20, break_long_words=False, break_on_hyphens=False, expand_tabs=False) for k, t in enumerate(texts)}


def test_polish(spark):
    want = {
        "  guard against  prom": "guard against prompt injection attacks.", "it ends": "it ends.", "done!": "done!", "a..b": "a.b.", "```\ncode": "```\ncode\n```.", "PROM": " prompt injection attacks.".strip(),
        "": "", "(fine)": "(fine)", "see secur,": "see security.",
    }
    frame = spark.createDataFrame([(k,) for k in [*want, None]], "t string")
    assert {x.t: x.p for x in frame.select("t", replies.polish(F.col("t")).alias("p")).collect()} == want | {None: None}
