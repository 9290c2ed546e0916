"""Best-fit packing under conflicts.

Documents are packed into bins of `capacity` bytes (a document takes its UTF-8 bytes and one end mark). A bin never
holds two documents of one source or of one duplicate cluster: a cluster that the caller names (op5_best_fit_packing: the
components of near duplicates, which hold equal texts too), else equal texts, case and white space aside. Bins stand in a
list ordered by residual space, and each carries a bitmap of its sources and one of its clusters; for a document (largest
first) the search starts at the smallest residual that holds it and goes to the successor until a compatible bin is
found, else a bin is opened.

Documents are dealt to shards of about `shard_docs` by a hash of doc_id, so a source with a third of all rows is spread
evenly; shards are packed independently, each in bounded memory. A document longer than a bin fills whole bins, its rest
is packed like a document. Every byte of every document is placed once.

Defined cases: null or empty text takes the end mark only and is in no cluster of near duplicates; null sources never
conflict; null doc_ids are dealt by cluster and size; ties go by doc_id, null last; repeated rows are placed as often as
they occur (same cluster, so never in one bin); an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trie_join

CAPACITY = 8192
SHARD_DOCS = 1024
RESULT = "doc_id long, piece int, bin_id long, bin_start long, length long, text_start long"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(size, source bit, cluster bit) in order of placement -> (bin, start). A bit of -1 never conflicts."""
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster in items:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        k = bisect_left(order, (size, -1))
        while k < len(order) and (sources[order[k][1]] & s or clusters[order[k][1]] & c):
            k += 1
        if k < len(order):
            residual, b = order.pop(k)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((b, capacity - residual))
        sources[b] |= s
        clusters[b] |= c
        insort(order, (residual - size, b))
    return placed


def _bits(values: pa.ChunkedArray) -> list[int]:
    """A bit for each value that occurs twice or more among the rows, -1 for the others and nulls."""
    values = values.to_pylist()
    often = sorted(v for v, n in Counter(values).items() if n > 1 and v is not None)
    code = {v: k for k, v in enumerate(often)}
    return [code.get(v, -1) for v in values]


def _pack_shard(capacity: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        # bits only for what can conflict within the shard
        sources, clusters = _bits(table["source"]), _bits(table["cluster"])
        ids, sizes = table["doc_id"].to_pylist(), table["size"].to_pylist()
        whole, rest = [], []
        for i, size in enumerate(sizes):
            full = size // capacity if size > capacity else 0
            whole += [(i, k) for k in range(full)]
            left = size - full * capacity
            if left or not full:
                rest.append((i, full, left))
        rest.sort(key=lambda x: (-x[2], ids[x[0]] is None, ids[x[0]] or 0, clusters[x[0]], x[0]))
        placed = best_fit([(left, sources[i], clusters[i]) for i, _, left in rest], capacity)
        used = 1 + max((b for b, _ in placed), default=-1)
        base = key[0].as_py() << 32
        rows = [(ids[i], full, base + b, start, left, full * capacity) for (i, full, left), (b, start) in zip(rest, placed)]
        rows += [(ids[i], k, base + used + n, 0, capacity, k * capacity) for n, (i, k) in enumerate(whole)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return pack


def _packed(rows: DataFrame, n_docs: int, capacity: int, shard_docs: int) -> DataFrame:
    """Packs rows of doc_id, source, cluster and size."""
    shards = max(1, -(-n_docs // shard_docs))
    # null doc_ids are spread by their sizes and clusters; rows that repeat a doc_id stay in one shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.hash("cluster", "size"))), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), RESULT)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), *more)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: Column | None = None) -> DataFrame:
    """Per placed piece: doc_id, piece, bin_id, bin_start, length and text_start (bytes). Rows of equal `cluster`, a long,
    conflict where it is not null; without it, rows of equal texts (case and white space aside)."""
    if cluster is None:
        cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+", " ")))
    return _packed(_rows(docs, cluster.cast("long").alias("cluster")), docs.count(), capacity, shard_docs)


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """`pack` with the components of near duplicates (equal texts among them) as clusters. Rows stand under a hash of doc_id
    and text, so that null and repeated doc_ids are parted like others; texts are not shuffled for it."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = trie_join.near_duplicates(docs.select(key.alias("_key"), F.col("text").cast("string").alias("text")), id_col="_key")
    roots = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("cluster"))
    return _packed(_rows(docs, key.alias("key")).join(roots, "key", "left"), docs.count(), capacity, shard_docs)
