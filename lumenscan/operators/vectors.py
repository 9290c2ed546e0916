"""Nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of vectors and of one of queries, and the entries of a product held at a time.
BLOCK, QUERY_BLOCK, PRODUCT = 8 << 20, 2 << 20, 1 << 22


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, one a row."""
    held = column.combine_chunks()
    held = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    return held / np.linalg.norm(held, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """q_id, vec_id, similarity: the k most similar vectors of each query, itself not included; ties by id. Null vectors are left out.

    The queries are a stated set, compared with all vectors in blocks that ids are dealt to by hash: every pair of blocks is one
    group, which keeps its best k of each query; these are merged at the end. Rows stay single until they meet in their group,
    and nothing is broadcast, as copies of queries grow with the number of vectors."""
    vectors, queries = (t.select("vec_id", "embedding").filter("embedding is not null") for t in (vectors, queries))
    counted = [t.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first() for t in (vectors, queries)]
    parts = [max(1, -(-n // (block or max(1, size // (4 * (d or 1)))))) for (n, d), size in zip(counted, (BLOCK, QUERY_BLOCK))]
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(rows: DataFrame, at: Column, q_at: Column):
        return rows.select(at.alias("block"), "*").select(q_at.alias("q_block"), "*").groupBy("block", "q_block")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if left.num_rows and right.num_rows:
            ids, q_ids = (t.column("vec_id").to_numpy() for t in (left, right))
            v, q, few = _rows(left.column("embedding")), _rows(right.column("embedding")), min(k, left.num_rows)
            step = max(1, PRODUCT // len(ids))
            for low in range(0, len(q_ids), step):
                likeness = np.round(q[low : low + step] @ v.T, 6)
                likeness[q_ids[low : low + step, None] == ids[None, :]] = -np.inf
                least = np.partition(likeness, -few, axis=1)[:, -few]
                for i, q_id in enumerate(q_ids[low : low + step]):
                    at = np.flatnonzero((likeness[i] >= least[i]) & np.isfinite(likeness[i]))
                    at = at[np.lexsort((ids[at], -likeness[i][at]))][:k]
                    out[0].append(np.full(len(at), q_id))
                    out[1].append(ids[at])
                    out[2].append(likeness[i][at])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(out, kinds)], names=["q_id", "vec_id", "similarity"])

    n, m = parts
    pairs = dealt(vectors, own(n), every(m)).cogroup(dealt(queries, every(n), own(m))).applyInArrow(best, "q_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
