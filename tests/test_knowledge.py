"""The splitter against a version on lists of strings; the store and its answers against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenscan.sources import knowledge as K
from lumenscan.sources import warehouse as W


def plain(text, size, overlap, marks):
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1 :]
    found = re.split(f"({re.escape(mark)})", text) if mark else []
    parts = [found[0], *(a + b for a, b in zip(found[1::2], found[2::2]))] if mark else list(text)
    out, good = [], []

    def merge(pieces):
        held, whole = [], 0
        for p in pieces:
            if whole + len(p) > size:
                if held:
                    out.append("".join(held).strip())
                while whole > overlap or (whole + len(p) > size and whole > 0):
                    whole -= len(held.pop(0))
            held.append(p)
            whole += len(p)
        if held:
            out.append("".join(held).strip())

    for p in [p for p in parts if p]:
        if len(p) < size:
            good.append(p)
            continue
        merge(good)
        good = []
        out.extend(plain(p, size, overlap, rest) if rest else [p])
    merge(good)
    return [c for c in out if c]


def test_split():
    r = random.Random(7)
    texts = ["", "   ", "a" * 95, "a " * 100, "\n\n" * 60, "x" * 40, "x" * 41]
    texts += ["".join(r.choice(["word", "w", "longer-word" * r.choice([1, 1, 8]), " ", " ", "\n", "\n\n", "é"]) for _ in range(r.randrange(200))) for _ in range(400)]
    for t in texts:
        for size, overlap in ((40, 10), (20, 0), (30, 29)):
            assert K.split(t, size, overlap) == (plain(t, size, overlap, ["\n\n", "\n", " ", ""]) if t else [])
    assert [len(c) for c in K.split("b" * 2500)] == [1000, 1000, 900]


def test_store_and_answers(spark):
    r, path = random.Random(2), W.scratch(spark, "kb")
    text = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(r.randrange(9)) for _ in range(300))
    rows = [(k, f"s{k % 3}", text()) for k in range(9)] + [(20, "s0", None), (21, "empty", ""), (22, None, "no source")]
    schema = "doc_id long, source string, text string"
    K.put(spark.createDataFrame(rows, schema), path)
    newer = [(30, "s1", text()), (31, "s9", "short text")]
    K.put(spark.createDataFrame(newer, schema), path)
    K.remove(spark, path, "s2", "never there")
    assert {tuple(x) for x in K.sources(spark, path).collect()} == {("s0", 1, 3), ("s1", 2, 1), ("s9", 2, 1), ("empty", 1, 0)}
    held = [(s, c) for i, s, t in [*[x for x in rows if x[1] == "s0"], *newer] for c in K.split(t or "")]
    questions = [(0, "alpha1 beta2"), (5, "short"), (7, None)]
    got = {x.q_id: x for x in K.retrieve(spark.createDataFrame(questions, "q_id long, text string"), path).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    for q, t in questions:
        likeness = sorted((-round(float(unit(K.embed(t or "").astype(float)) @ unit(K.embed(c).astype(float))), 6) for _, c in held))[:4]
        told = got[q].context.split("\n\n---\n\n")
        assert len(told) == 4 and got[q].sources == sorted({x.removeprefix("Source: ").split("\n")[0] for x in told})
        found = [-round(float(unit(K.embed(t or "").astype(float)) @ unit(K.embed(x.split("\nContent: ")[1]).astype(float))), 6) for x in told]
        assert np.allclose(found, likeness, atol=2e-6)


def test_chunks_leave_in_slices():
    """A batch of texts makes more vectors than fit at once."""
    texts = ["word " * 90000, None, "a b", ""] * 2
    batch = pa.RecordBatch.from_pydict({"source": ["s", "s", None, "t"] * 2, "doc_id": [*range(8)], "text": texts})
    parts = list(K.sliced(iter([batch]), K.SIZE, K.OVERLAP))
    assert [p.num_rows for p in parts] == [K.SLICE] * (len(parts) - 1) + [parts[-1].num_rows] and len(parts) > 1
    rows = [r for p in parts for r in p.to_pylist()]
    want = [(batch.column("source")[i].as_py(), i, k, c, K.embed(c).tolist()) for i, t in enumerate(texts) for k, c in enumerate(K.split(t or ""))]
    assert [tuple(r.values()) for r in rows] == want


def test_vectors_and_texts_are_not_dealt_where_sources_and_answers_are_few(spark):
    """All chunks of a source would land in one task."""
    docs = spark.createDataFrame([(k, f"s{k % 2}", " ".join(f"w{k * j}" for j in range(300))) for k in range(200)], "doc_id long, source string, text string")
    path, asked = W.scratch(spark, "kb"), docs.filter("doc_id < 3").select(F.col("doc_id").alias("q_id"), "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        K.put(docs, path)
        K.put(docs.filter("source = 's1'"), path)
        for rows, n in ((K.current(spark, path).filter("chunk is not null").select("doc_id", "embedding"), 200), (K.retrieve(asked, path), 3)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            assert len({r[0] for r in rows.collect()}) == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
