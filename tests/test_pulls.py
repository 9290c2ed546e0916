"""Pull requests read from a server of this test, with what it was asked for."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath
from urllib.parse import parse_qs, unquote, urlparse

import pytest

from lumenscan.sources import pulls as P

PATCH = "@@ -1,2 +1,3 @@\n a\n+b\n c"
FILES = {
    1: [{"filename": f"src/f{k:03}.{('py', 'js', 'md')[k % 3]}", "status": "modified", "patch": PATCH} for k in range(230)],
    2: [{"filename": "a b.py", "status": "added", "patch": PATCH}, {"filename": "gone.py", "status": "removed", "patch": PATCH}, {"filename": "image.py", "status": "added"}, {"filename": "no-body.py", "status": "added", "patch": PATCH}],
    3: [],
    4: [{"filename": "x.py", "status": "added", "patch": PATCH}] * 100,  # the list breaks off after its first page
}


@pytest.fixture()
def server():
    asked: list[str] = []

    class Host(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            asked.append(self.path)
            parts, reply = unquote(url.path).split("/", 4)[4:], None
            kind, _, rest = parts[0].partition("/")
            if kind == "contents" and rest != "no-body.py":
                assert parse_qs(url.query)["ref"][0].startswith("sha")
                reply = {"content": base64.encodebytes(f"body of {rest} \xff".encode("latin-1")).decode()}
            elif kind == "pulls" and rest.endswith("/files"):
                n, page = int(rest.split("/")[0]), int(parse_qs(url.query)["page"][0])
                reply = None if n == 4 and page > 1 else FILES[n][100 * (page - 1) : 100 * page]
            elif kind == "pulls" and int(rest) in FILES:
                reply = {"head": {"sha": f"sha{rest}"}}
            self.send_response(404 if reply is None else 200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    host = ThreadingHTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=host.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{host.server_port}", asked
    host.shutdown()


def load(spark, api, numbers, **options):
    return P.pull_requests(spark, api=api, repo="o/r", numbers=numbers, pullsPerTask="1", **options)


def test_reads_all_pages_and_bodies(spark, server):
    api, asked = server
    rows = load(spark, api, "2,1,3,2").collect()
    first = {r.filename: r for r in rows if r.number == 1}
    assert len(first) == 230 and all(r.content == f"body of {r.filename} �" and r.patch == PATCH for r in first.values())
    second = {r.filename: (r.status, r.patch, r.content) for r in rows if r.number == 2}
    assert second == {"a b.py": ("added", PATCH, "body of a b.py �"), "gone.py": ("removed", PATCH, None), "image.py": ("added", "", None), "no-body.py": ("added", PATCH, None)}
    assert len(rows) == 234 and not any("page=4" in a for a in asked)


def test_errors_are_rows(spark, server):
    rows = load(spark, server[0], "3,4,9").collect()
    assert sorted((r.number, r.filename) for r in rows) == [(4, None), (9, None)] and all("404" in r.error for r in rows)
    assert load(spark, server[0], "").count() == 0


def test_filters_hold_at_the_reader(spark, server):
    api, asked = server
    rows = load(spark, api, "1,2,3", extensions="py,md").filter("number in (1, 3) and endswith(filename, '.md')").collect()
    want = {f["filename"] for f in FILES[1] if f["filename"].endswith(".md")}
    assert {r.filename for r in rows} == want and len(rows) == len(want)
    bodies = [a for a in asked if "/contents/" in a]
    assert len(bodies) == len(want) and not any("/pulls/2" in a for a in asked)


def test_extensions_and_lines(spark):
    names = ["a.py", "b/.py", "b.d/Makefile", "c.tar.gz", "d.", "e.PY", "x/..py", "noext", "f.ts"]
    assert [P.extension(n) for n in names] == [PurePosixPath(n).suffix.lstrip(".") for n in names]
    files = spark.createDataFrame([(1, n, PATCH, "x") for n in names] + [(1, "null.py", PATCH, None), (2, "a.py", "", "x"), (3, "b.py", PATCH + "\n@@ -9 +11 @@\n-z\n+y", "x")], "number long, filename string, patch string, content string")
    scanned = files.filter(P.in_scope())
    assert sorted((r.number, r.filename) for r in scanned.collect()) == sorted([(1, n) for n in names if P.extension(n) in P.EXTENSIONS] + [(2, "a.py"), (3, "b.py")])
    got = sorted((r.number, r.filename, r.line_no) for r in P.changed_in_pulls(scanned.filter("number > 1")).collect())
    assert got == [(3, "b.py", 2), (3, "b.py", 11)]
