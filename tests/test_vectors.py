"""Nearest neighbours against brute force."""

import numpy as np

from lumenscan.operators.vectors import nearest


def test_nearest_sends_nothing_to_the_driver(spark):
    """Queries are copied for each block of vectors, so they are not broadcast; blocks of every size give the same rows."""
    draw = np.random.default_rng(3)
    held = draw.integers(-3, 4, (90, 5)).astype(float) + 0.5
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(held)], "vec_id long, embedding array<float>")
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    want = {(q, k, s) for q in range(0, 90, 9) for s, k in [(-s, k) for s, k in sorted((-round(float(unit[q] @ unit[k]), 6) + 0.0, k) for k in range(90) if k != q)[:4]]}
    for block in (None, 7, 90):
        found = nearest(v, v.filter("vec_id % 9 = 0"), 4, *([block] if block else []))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.q_id, r.vec_id, r.similarity) for r in found.collect()} == want
