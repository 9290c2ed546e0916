"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased and freed of ASCII punctuation, then hashed to FEATURES columns.

1. Document frequencies of the features over all documents (one pass; every task sends one vector of fixed size).
2. The TF-IDF passages of the benchmark are factorised by a randomised SVD: the tasks multiply their rows with the
   current basis and send partial products, the driver orthogonalises a FEATURES x (rank + 8) matrix. The rank is RANK, or
   half the number of items if that is less. Passages that keep less than MIN_ENERGY of their energy in the latent space
   (wording that no leading direction holds) are factorised again without what the space holds already, and the new
   directions are added, until each passage keeps that much or MAX_RANK is reached; passages beyond it get an index, and
   a pass over the documents, of their own. Only the benchmark is fitted; all documents are searched.
3. Each window of 2 * STRIDE words, STRIDE apart, of every whole text is folded into the latent space. A window and an
   item are a candidate if the cosine of the window with the item's latent passage reaches MIN_COSINE.
4. A candidate is compared word by word: the longest common subsequence of the item and the text around the window must
   cover MIN_LCS of the item, and MIN_ANSWER of its answer words (its last third) must stand there too.

Beside the latent space, which proves nothing about single items, stands a gate for copies word for word: of each item the run
of ANCHOR words of the greatest weight is looked up in all texts, and the words around it are compared. So no verbatim copy is
lost, whatever stands around it. Items of fewer than MIN_WORDS words, of which a subsequence says little, are matched by the
gate only.

Defined cases: null and empty texts and items match nothing; null doc_ids are reported as null; repeated documents or items give one row for each pair of ids; empty tables give no
rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import free_names, materialize
from ._text import PUNCTUATION, Words, grams, slices

FEATURE_BITS = 14
STRIDE = 16
RANK = 96
MAX_RANK = 512
MIN_ENERGY = 0.25
MIN_COSINE = 0.25
MIN_LCS = 0.6
MIN_ANSWER = 0.6
MIN_WORDS = 8
ANCHOR = 4
#: An index holds about so many items, and about so many bytes of them.
BLOCK_ITEMS = 8192
BLOCK_BYTES = 1 << 23
_FOLD = 512  # blocks of words folded at once
_BLOCKS = 16
RESULT = "doc_id long, item_id long, lcs_words long, item_words long, answer_found long, answer_words long"


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, lower=True, space=PUNCTUATION)


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents hold each feature; the last number is that of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                w = _words(data, offsets)
                pairs = np.unique((w.doc() << FEATURE_BITS) | _features(w.hash))
                total[:-1] += np.bincount(pairs & ((1 << FEATURE_BITS) - 1), minlength=1 << FEATURE_BITS)
                total[-1] += len(w.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
    for feature, n in counts:  # at most 2^FEATURE_BITS + 1 rows
        out[feature] = n
    return out


def _dense(hash_lists: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(hash_lists), 1 << FEATURE_BITS), np.float32)
    for k, hashes in enumerate(hash_lists):
        np.add.at(rows[k], _features(hashes), idf[_features(hashes)])
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm, norm, 1)


def randomised_svd(items: DataFrame, idf: np.ndarray, rank: int, known: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors (features x rank) of the items' TF-IDF rows, which stay on the executors; with a
    basis known before, those of what it leaves of the rows that it holds badly."""
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((1 << FEATURE_BITS, rank + 8)).astype(np.float32))[0]

    def product(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape, np.float32)
            for batch in batches:
                for _, data, offsets in slices(batch.column(0), 1 << 14):
                    w = _words(data, offsets)
                    a = _dense([w.hash[i:j] for i, j in zip(w.first[:-1], w.first[1:])], idf)
                    if known is not None:
                        latent = a @ known
                        a = (a - latent @ known.T)[np.einsum("ij,ij->i", latent, latent) < MIN_ENERGY]
                    total += a.T @ (a @ basis)
            blocks = [x.tobytes() for x in np.split(total, _BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["part"])
            return pd.DataFrame({"block": frame["block"][:1], "part": [total.astype(np.float32).tobytes()]})

        parts = items.select("text").coalesce(16).mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
        out = np.empty(basis.shape, np.float32)
        for r in parts.collect():  # one matrix
            out[r["block"] * len(out) // _BLOCKS : (r["block"] + 1) * len(out) // _BLOCKS] = np.frombuffer(r["part"], np.float32).reshape(-1, out.shape[1])
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    lead = np.argsort(-values)[:rank]
    return (basis @ vectors[:, lead[values[lead] > 1e-6]]).astype(np.float32)


class Passages:
    """The items of an index: ids, word hashes and sparse TF-IDF rows; those without words are left out."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray):
        self.ids: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for first, data, offsets in slices(pa.array([t for _, t in items], pa.string())):
            w = _words(data, offsets)
            for k, (i, j) in enumerate(zip(w.first[:-1], w.first[1:])):
                if j > i:
                    at, n = np.unique(_features(w.hash[i:j]), return_counts=True)
                    self.ids.append(items[first + k][0])
                    self.hashes.append(w.hash[i:j])
                    self.rows.append((at, (n * idf[at]).astype(np.float32)))

    def latent(self, basis: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), basis.shape[1]), np.float32)
        for own, (at, value) in zip(out, self.rows):
            own[:] = value @ basis[at]
        return out

    def lost(self, basis: np.ndarray) -> np.ndarray:
        """The places of items that keep too little energy in the latent space."""
        latent = self.latent(basis)
        energy = np.array([value @ value for _, value in self.rows])
        return np.flatnonzero(np.einsum("ij,ij->i", latent, latent) < MIN_ENERGY * energy)


def latent_basis(items: DataFrame, passages: Passages, idf: np.ndarray) -> np.ndarray:
    """A basis in which each passage keeps MIN_ENERGY of its energy, or one of MAX_RANK vectors."""
    basis = randomised_svd(items, idf, min(RANK, -(-len(passages.ids) // 2)))
    while True:
        lost = passages.lost(basis)
        rank = min(RANK, -(-len(lost) // 2), MAX_RANK - basis.shape[1])
        more = randomised_svd(items, idf, rank, basis) if rank > 0 else basis[:, :0]
        if not more.shape[1]:
            return basis
        basis = np.linalg.qr(np.hstack([basis, more]))[0].astype(np.float32)


def lcs_length(item_masks: dict[int, int], n: int, text: list[int]) -> int:
    """Bit-parallel longest common subsequence of an item (positions of each word as a mask) and a text."""
    full = (1 << n) - 1
    row = full
    for w in text:
        m = item_masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - bin(row).count("1")


class Index:
    """Latent vectors, words, masks, answers and anchors of some items."""

    def __init__(self, passages: Passages, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.hashes, self.idf = passages.ids, passages.hashes, idf
        latent = passages.latent(basis)
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = np.ascontiguousarray((latent / np.where(norm, norm, 1)).T)
        live = np.flatnonzero(basis.any(axis=1))
        self.row = np.full(1 << FEATURE_BITS, -1, np.int64)
        self.row[live] = np.arange(len(live))
        #: A row per feature: what one such word adds to its window's place in the latent space.
        self.table = np.ascontiguousarray(basis[live] * idf[live, None])
        self.masks, self.answers = [], []
        anchors: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, h in enumerate(self.hashes):
            masks: dict[int, int] = {}
            for k, x in enumerate(h.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)
            self.answers.append(set(h[-max(2, len(h) // 3) :].tolist()))
            m = min(ANCHOR, len(h))
            at = int(np.argmax(np.convolve(idf[_features(h)], np.ones(m), "valid")))
            anchors.setdefault(m, {}).setdefault(int(grams(h[at : at + m], m)[0]), []).append((item, at))
        #: By length of the run: its sorted hashes, and the items and places of each.
        self.anchors = [(m, np.array(sorted(of), np.uint64), of) for m, of in sorted(anchors.items())]

    def verbatim(self, w: Words) -> Iterator[tuple[int, int]]:
        """(document, item) of copies word for word."""
        for m, hashes, places in self.anchors:
            g = grams(w.hash, m)
            at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            for q in np.flatnonzero(hashes[at] == g).tolist():
                d = int(np.searchsorted(w.first, q, "right")) - 1
                for item, place in places[int(g[q])]:
                    own = self.hashes[item]
                    start = q - place
                    if start >= w.first[d] and start + len(own) <= w.first[d + 1] and np.array_equal(w.hash[start : start + len(own)], own):
                        yield d, item

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(document, first word of the window, item) of near windows."""
        blocks = -(-w.count // STRIDE)
        block_first = np.concatenate([[0], np.cumsum(blocks)])
        n_blocks = int(block_first[-1])
        doc = w.doc()
        block = block_first[doc] + (np.arange(len(doc)) - w.first[doc]) // STRIDE
        feature = _features(w.hash)
        norm = np.bincount(block, self.idf[feature] ** 2, n_blocks)
        row = self.row[feature]
        at = np.flatnonzero(row >= 0)
        own, row = block[at], row[at]
        of_block = np.repeat(np.arange(len(blocks)), blocks)
        pair = np.zeros(n_blocks, bool)
        pair[:-1] = of_block[:-1] == of_block[1:]
        norm[:-1][pair[:-1]] += norm[1:][pair[:-1]].copy()
        reach = (MIN_COSINE * np.sqrt(np.maximum(norm, 1e-9))).astype(np.float32)
        for k in range(0, n_blocks, _FOLD):
            end = min(k + _FOLD, n_blocks)
            i, j = np.searchsorted(own, [k, end + 1])
            folded = np.zeros((end + 1 - k, self.table.shape[1]), np.float32)
            if j > i:
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(own[i:j])) + 1])
                folded[own[i:j][cuts] - k] = np.add.reduceat(self.table[row[i:j]], cuts)
            window = folded[:-1].copy()
            both = np.flatnonzero(pair[k:end])
            window[both] += folded[both + 1]
            for b, item in zip(*(x.tolist() for x in np.nonzero(window @ self.latent >= reach[k:end, None]))):
                d = int(of_block[k + b])
                yield d, int(w.first[d]) + (k + b - int(block_first[d])) * STRIDE, item

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, lcs, words, answers found, answers) for every row's matches."""
        for first_row, data, offsets in slices(column):
            w = _words(data, offsets)
            if not len(w.hash) or not self.ids:
                continue
            best = {(d, item): (len(self.hashes[item]), len(self.answers[item])) for d, item in self.verbatim(w)}
            for d, start, item in self.candidates(w):
                n = len(self.hashes[item])
                if n < MIN_WORDS or best.get((d, item), (0, 0))[0] == n:
                    continue
                region = w.hash[max(int(w.first[d]), start - n) : min(int(w.first[d + 1]), start + 2 * STRIDE + n)].tolist()
                found = len(self.answers[item].intersection(region))
                if found < MIN_ANSWER * len(self.answers[item]):
                    continue
                common = lcs_length(self.masks[item], n, region)
                if common >= MIN_LCS * n:
                    best[d, item] = max(best.get((d, item), (0, 0)), (common, found))
            for (d, item), (common, found) in sorted(best.items()):
                yield first_row + d, item, common, len(self.hashes[item]), found, len(self.answers[item])


def _indexes(items: DataFrame, idf: np.ndarray) -> Iterator[Index]:
    """One index for about BLOCK_ITEMS items, and one more for the items of a block that its latent space does not hold."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        waiting = [(some, [(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()])]  # a block
        while waiting:
            some, own = waiting.pop()
            passages = Passages(own, idf)
            if not passages.ids:
                continue
            basis = latent_basis(some, passages, idf)
            yield Index(passages, idf, basis)
            lost = {passages.ids[x] for x in passages.lost(basis)} if basis.shape[1] else set()
            rest, part = [x for x in own if x[0] in lost], min(2 * MAX_RANK, len(own) // 2)  # ever fewer, so it ends
            waiting += [(items.sparkSession.createDataFrame(x, items.schema), x) for x in (rest[j : j + part] for j in range(0, len(rest), max(part, 1)))]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it repeats or paraphrases."""
    spark = docs.sparkSession
    counts = document_frequencies(docs)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], RESULT)
    for own in _indexes(items, idf):
        index = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.value.search(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                item_ids = pa.array([index.value.ids[f[1]] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, item_ids, *(pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4, 5))], names=["doc_id", "item_id", "lcs_words", "item_words", "answer_found", "answer_words"])

        out = out.union(rows.mapInArrow(run, RESULT))
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("lcs_words", "item_words", "answer_found", "answer_words")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no benchmark item, with all their columns, in one more narrow pass."""
    (own,) = free_names(docs, "leak")
    leaks = matches(docs, benchmark).select(F.col("doc_id").alias(own)).filter(f"`{own}` is not null").distinct()
    return docs.join(materialize(leaks, "leaks"), F.col("doc_id") == F.col(own), "left_anti")
