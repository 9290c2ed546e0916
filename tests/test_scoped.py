"""Findings of whole files, expected by hand on the snippets, and their defined cases."""

import pytest

from lumenscan.operators import scoped as S
from lumenscan.sources.corpus import SNIPPETS, code_files


def at(prefix: str) -> int:
    (k,) = [k for k, (_, code) in enumerate(SNIPPETS, 1) if code.startswith(prefix)]
    return k


EXPECTED = {
    "sql_injection": {("uid = request.form", 3, "query"), ("cursor.execute(f", 1, None), ("b = a", 3, "b"), ("sql = ", 12, "q"), ("sql = ", 17, "w"), ("sql = ", 20, "other")},
    "tool_lists": {("agent = 1", 2, 2, "os.remove, subprocess.run"), ("agent = 1", 3, 2, "shell=true, sudo")},
    "log_injection": {("def act", 2, "name"), ("def act", 3, "n"), ("def act", 5, "name"), ("who = request.args", 4, "line")},
    "cross_site_scripting": {("def do_GET", 5, "who"), ("def do_POST", 9, "a")},
    "open_redirects": {("to = request", 2)},
    "memory_exhaustion": {("def grow", 2), ("def grow", 3), ("def grow", 18)},
    "format_strings": {("t = input", 2, "tainted_format_template"), ("t = input", 3, "request_template_format"), ("t = input", 4, "tainted_percent_template"), ("t = input", 6, "tainted_percent_template")},
    "xml_entities": {
        ("import xml", 4, "alias_xml_call"), ("import xml", 5, "alias_func_call"), ("import xml", 7, "unsafe_xml_call"), ("import xml", 8, "explicit_enabler"),
        ("from defusedxml", 5, "explicit_enabler"), ("from defusedxml", 5, "unsafe_xml_call"),
    },
    "encoded_paths": {('if ".." in path', 3, "path"), ('if ".." in path', 5, "p")},
    "quoted_shells": {("q = shlex", 3, "q"), ("q = shlex", 6, "r")},
    "signed_loads": {("if verify", 2)},
}


def rows(frame) -> set[tuple]:
    own = [c for c in frame.columns if c not in ("file_id", "line_number", "detector_name", "vulnerability_type", "severity", "cwe_id", "confidence")]
    return {(r.file_id, r.line_number, *(r[c] for c in own)) for r in frame.collect()}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_expected(spark, name):
    mine = {at(p) for f in EXPECTED.values() for p, *_ in f}
    got = {r for r in rows(getattr(S, name)(code_files(spark))) if r[0] in mine}
    assert got == {(at(p), *rest) for p, *rest in EXPECTED[name]}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_null_empty_and_repeated_files(spark, name):
    one = code_files(spark).filter(f"file_id = {at(sorted(EXPECTED[name])[0][0])}")
    odd = spark.createDataFrame([(901, "a.py", "python", None), (902, "b.py", "python", ""), (903, None, None, "x")], one.schema)
    f = getattr(S, name)
    assert f(odd).count() == 0 and f(one.limit(0)).count() == 0
    assert rows(f(one.union(odd))) == rows(f(one))
