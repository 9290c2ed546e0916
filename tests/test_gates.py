"""What files must hold before patterns are tried: no match may lack it, and texts are read once."""

import random
import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from lumenscan.operators import detectors as D
from lumenscan.operators import union as U


def sample(parsed, r):
    """A random text that the parsed pattern matches, lookarounds aside."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "NOT_LITERAL":
                out += "z" if arg != ord("z") else "y"
            case "ANY":
                out += r.choice("ab ")
            case "IN":
                kinds = {"CATEGORY_WORD": "w", "CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "7", "CATEGORY_NOT_DIGIT": "x", "CATEGORY_NOT_WORD": "-"}
                if str(arg[0][0]) == "NEGATE":
                    out += "q"
                    continue
                kind, value = r.choice(arg)
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(r.randint(*value)), "CATEGORY": lambda: kinds[str(value)]}[str(kind)]()
            case "BRANCH":
                out += sample(r.choice(arg[1]), r)
            case "SUBPATTERN":
                out += sample(arg[3], r)
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, part = arg
                out += "".join(sample(part, r) for _ in range(r.randint(low, min(high, low + 2))))
            case "AT" | "ASSERT" | "ASSERT_NOT":
                pass
            case _:
                raise AssertionError(op)
    return out


@pytest.mark.parametrize("detector", D.ALL, ids=lambda d: d.name)
def test_no_match_lacks_what_it_needs(detector):
    r = random.Random(5)
    for pattern, needs in [*((x.pattern, x.needs or detector.needs) for x in detector.rules), *([(detector.seeds[0], detector.needs)] if detector.seeds else [])]:
        parsed = parser.parse(pattern)
        for _ in range(300):
            text = sample(parsed, r)
            assert re.search(needs, text) if isinstance(needs, str) else any(n in text for n in needs), (pattern, text)
    if detector.file:
        assert set(detector.needs) == set(detector.file.split("|"))


def test_texts_are_read_once(spark, tmp_path):
    code = ["plain words", "h = hashlib.md5(x)", "k = os.path.exists(p)\nopen(p)", "r.set_cookie('a', secure=False)", "u = input()\nlog.info(u)", "import xml.sax as s\ns.parse(f)", None, 'iv = b"0123456789ab"\naes']
    rows = [(k, "a", "en", c) for k, c in enumerate(code)] + [(50 + k, "a.py", "python", c) for k, c in enumerate(code)]
    spark.createDataFrame(rows, "file_id long, path string, language string, code string").write.parquet(f"{tmp_path}/texts")
    files = spark.read.parquet(f"{tmp_path}/texts")
    for found in (U.all_findings(files), D.detect_all(files)):
        assert not [f for f in found.inputFiles() if "texts" in f]
    got = {tuple(r) for r in U.all_findings(files).select("file_id", "line_number", "vulnerability_type").collect()}
    assert got == {tuple(r) for r in U.all_findings(files, narrow=False).select("file_id", "line_number", "vulnerability_type").collect()}
    assert {f for f, _, _ in got if f < 50} >= {1, 2, 3, 4, 5, 7}
    assert {r.file_id for r in U.narrowed(files).filter(F.col("file_id") < 50).collect()} >= {1, 2, 3, 4, 5, 7} and not U.narrowed(files).filter("file_id = 0").count()
