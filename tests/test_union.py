"""The union of all detectors over files made for it, and the SQL of its owners."""

import duckdb
import pytest

from lumenscan import catalog
from lumenscan.operators import scoped as S
from lumenscan.plans import scoped

#: Files with unsafe loads behind checks of signatures, or nearly so.
CODES = (
    "if verify(sig, data):\n    x = yaml.load(data, Loader=yaml.SafeLoader)\nelse:\n    y = pickle.loads(d)",
    "if ok:\n    pass\nelif hmac.compare_digest(a, b):\n    if x:\n        a = pickle.loads(d)\n    b = marshal.loads(e)\nelse:\n    c = yaml.load(d)\nd = pickle.load(x)",
    "if 'verify' in x:\n    pickle.loads(d)",
    "if self.verified:\n    pickle.loads(d)",
    "if self.verify():\n\n    # pickle.loads(d)\n    z = my.pickle.loads(d)\n    pickle.load(d)",
    "def f():\n    if check(signature=s): return pickle.loads(d)\n    if check(a=signature): return pickle.loads(d)",
    "if verify(\n    (a):\n  x = pickle.loads(d)",
    "for k in x:\n    if authentic:\n        q = f(pickle.loads(k))\n    w = pickle.loads(z)",
)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder whose documents are those files, and a database that reads it."""
    folder = str(tmp_path_factory.mktemp("made"))
    rows = [(k, c, "python", "a.py", len(c)) for k, c in enumerate(CODES)] + [(90, None, "python", "b.py", 0), (91, CODES[0], "en", "c.py", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, db


def test_sql_of_signed_loads(made):
    got = sorted(r[:2] for r in made[1].execute(scoped.SIGNED_LOADS_SQL).fetchall() if r[0] >= 0)
    assert got == sorted((k, line) for k, code in enumerate(CODES) for line in S._gated_loads(code)) and len(got) == 5


def test_owners_include_syntax_trees(spark, made):
    folder, db = made
    names = ("file_id", "line_number", "lower_type", "detector_name", "det_ord")
    got = sorted(tuple(r[c] for c in names) for r in catalog.queries()["dedup_union_full"](spark, folder).collect())
    assert got == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['dedup_union_full']})").fetchall())
    assert {r[:4] for r in got} >= {(0, 2, "unsafe deserialization", S.EVASION)}
