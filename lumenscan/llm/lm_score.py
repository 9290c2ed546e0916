"""Cross-entropy difference scores.

A target model (documents chosen by labels) and a background model (all documents) are interpolated bigram models over
one vocabulary: words hashed to 2^WORD_BITS slots, bigrams to 2^PAIR_BITS slots. Every task counts its words and
bigrams and sends the slots it has met; these partial counts, which grow with the corpus, are summed by range of slots. The
finished tables have a fixed size (2 * 2^PAIR_BITS + 4 * 2^WORD_BITS numbers a fold), which is why they may be broadcast; both
sizes are parameters of `fit`.

With `folds` of 2 or more, texts are dealt to folds by their hash and each is scored by models that counted the other folds
only, so no text, nor any copy of it, is scored by a model that has seen it; target documents would else look nearer to the
target than they are. Every text is still counted. The tables are held once a fold. One fold: scores by counts of all texts.

A token's probability after a word that the model knows is LAMBDAS of its bigram, word and uniform probability; at a
document's start and after an unknown word (one that no bigram of the model begins with) the bigram's share goes to the
word's probability, so both models spread the same mass whatever they have seen. A document's score is the mean over its
tokens of target loss minus background loss, in bits: lower means nearer to the target.

The vocabulary is one of slots: words of one slot are one word to both models. As a corpus grows, slots hold more words
each and scores blur; both sizes are parameters, and the README states where they fill up.

Defined cases: null and empty texts have no tokens and a null score; texts of any length are read whole; null doc_ids are
scored; repeated rows are counted as often as they occur and get equal scores; without target documents the target model
is uniform; an empty table gives no rows; other columns are not touched. Equal texts are of one fold and get equal scores; where all texts are
of one fold, the models of the others have seen nothing and are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bloom
from ._store import materialize
from ._text import Words, grams, slices

WORD_BITS = 18
PAIR_BITS = 21
SLICES = 32
#: Weights of bigram, word and uniform probabilities.
LAMBDAS = (0.6, 0.35, 0.05)
_TABLES = tuple(f"{unit}_{kind}" for unit in ("pair", "word", "first") for kind in ("target", "background"))
_PART = "name string, slice int, part int, counts binary"


def _dump(at: np.ndarray, n: np.ndarray) -> bytes:
    return zstandard.compress(at.astype("<u4").tobytes() + n.astype("<u8").tobytes(), 1)


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    k = len(raw) // 12
    return np.frombuffer(raw[: 4 * k], "<u4"), np.frombuffer(raw[4 * k :], "<u8")


class Model:
    """Tables with a row for each fold: the counts that its texts are scored by."""

    def __init__(self, tables: dict[str, np.ndarray], word_bits: int, pair_bits: int):
        self.word_bits, self.pair_bits = word_bits, pair_bits
        self.tables = tables
        self.folds = len(tables["word_target"])
        self.sums = {k: tables[f"word_{k}"].sum(axis=1, dtype=np.float64) for k in ("target", "background")}

    def losses(self, column: pa.Array, folds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, target bits, background bits) per row, for a slice of rows at a time."""
        a, b, c = LAMBDAS
        for start, data, offsets in slices(column):
            w = Words(data, offsets, lower=True)
            fold = folds[start + w.doc()]
            slot = (w.hash >> np.uint64(64 - self.word_bits)).astype(np.int64)
            pair = (grams(w.hash, 2) >> np.uint64(64 - self.pair_bits)).astype(np.int64)
            inner = np.zeros(len(slot), bool)
            inner[1:] = True
            inner[w.first[:-1][w.count > 0]] = False
            at = np.flatnonzero(inner)
            out = [w.count]
            for kind in ("target", "background"):
                words, pairs, firsts = (self.tables[f"{unit}_{kind}"] for unit in ("word", "pair", "first"))
                uniform = 1 / (1 << self.word_bits)
                sums = self.sums[kind][fold]
                unit = np.where(sums > 0, words[fold, slot] / np.maximum(sums, 1), uniform)
                p = (a + b) * unit + c * uniform
                before = firsts[fold[at], slot[at - 1]]
                known = before > 0
                own = at[known]
                p[own] += a * (np.minimum(1.0, pairs[fold[own], pair[own - 1]] / before[known]) - unit[own])
                bits = np.zeros(len(slot) + 1)
                np.cumsum(-np.log2(p), out=bits[1:])
                out.append(bits[w.first[1:]] - bits[w.first[:-1]])
            yield tuple(out)


def _count(kind: str, word_bits: int, pair_bits: int, folds: int):
    """Counts words and bigrams of a task's texts (fold, text) and sends the slots that it has met, by fold and in ranges of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(unit, f): np.zeros(1 << bits, np.int64) for unit, bits in (("word", word_bits), ("pair", pair_bits), ("first", word_bits)) for f in range(folds)}
        for batch in batches:
            of_row = batch.column(0).to_numpy()
            for start, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, lower=True)
                doc = w.doc()
                fold = of_row[start + doc]
                slot = (w.hash >> np.uint64(64 - word_bits)).astype(np.int64)
                pair = (grams(w.hash, 2) >> np.uint64(64 - pair_bits)).astype(np.int64)
                inner = doc[1:] == doc[:-1]
                for unit, some, of in (("word", slot, fold), ("pair", pair[inner] if len(doc) else pair, fold[1:][inner]), ("first", slot[:-1][inner], fold[1:][inner])):
                    for f in range(folds):
                        at, n = np.unique(some[of == f] if folds > 1 else some, return_counts=True)
                        total[unit, f][at] += n
        names, ranges, blobs = [], [], []
        for (unit, f), counts in total.items():
            for k, part in enumerate(np.split(counts, SLICES)):
                at = np.flatnonzero(part)
                if len(at):
                    names.append(f"{unit}_{kind}_{f}")
                    ranges.append(k)
                    blobs.append(_dump(at, part[at]))
        part = [TaskContext.get().partitionId()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ranges, pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["name", "slice", "part", "counts"])

    return run


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold")


def target_texts(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The texts of the target. A Bloom filter of fixed size lets its rows and few others through before the exact join;
    the join is by shuffle whatever the sizes, so that the plan does not change where the ids outgrow a broadcast. From
    some 10^6 ids on the filter fills (4.6 million: about 18 % of other rows pass); at worst every text is shuffled once."""
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct()
    packed = docs.sparkSession.sparkContext.broadcast(_bloom.build(chosen, "_id"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _bloom.Filter(packed.value)
        for batch in batches:
            yield batch.filter(pa.array(keep.may_have(batch.column(0).to_numpy())))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    some = rows.mapInArrow(may, "doc_id long, text string")
    return some.join(chosen.hint("merge"), some.doc_id == chosen._id, "left_semi").select("text")


def fit(docs: DataFrame, target_ids: DataFrame, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS, folds: int = 1) -> Model:
    """Counts over all documents; target_ids has the doc_id of each document of the target."""
    if folds < 1:
        raise ValueError("folds must be 1 or more")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["name"].iloc[0]
        total = np.zeros((1 << (pair_bits if name.startswith("pair") else word_bits)) // SLICES, np.uint64)
        for blob in frame["counts"]:
            at, n = _load(blob)
            total[at] += n
        at = np.flatnonzero(total)
        return pd.DataFrame({"name": [name], "slice": frame["slice"].iloc[:1].tolist(), "part": [0], "counts": [_dump(at, total[at])]})

    background = docs.select(F.col("text").cast("string").alias("text")).select(_fold(folds), "text").mapInArrow(_count("background", word_bits, pair_bits, folds), _PART)
    target = target_texts(docs, target_ids).select(_fold(folds), "text").mapInArrow(_count("target", word_bits, pair_bits, folds), _PART)
    parts = materialize(background.union(target), "lm-parts")
    some = parts.groupBy("name", "slice", F.expr("part div 256")).applyInPandas(lambda key, f: add(f), _PART)
    whole = materialize(some.groupBy("name", "slice").applyInPandas(add, _PART), "lm-model")
    tables = {n: np.zeros((folds, SLICES, (1 << (pair_bits if n.startswith("pair") else word_bits)) // SLICES), np.float32) for n in _TABLES}
    for r in whole.toLocalIterator():  # tables of fixed size, a part at a time
        at, n = _load(bytes(r["counts"]))
        name, fold = r["name"].rsplit("_", 1)
        for f in range(folds):
            if f != int(fold) or folds == 1:
                tables[name][f, r["slice"]][at] += n
    return Model({k: v.reshape(folds, -1) for k, v in tables.items()}, word_bits, pair_bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits (means per token) and their difference, score. A narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(sent.value.losses(batch.column(1), batch.column(2).to_numpy()))
            n, t, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            none = n == 0
            safe = np.maximum(n, 1)
            columns = [pa.array(x, pa.float64(), mask=none) for x in (t / safe, b / safe, (t - b) / safe)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *columns], names=["doc_id", "n_tokens", "target_bits", "background_bits", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("*", _fold(model.folds)).mapInArrow(run, "doc_id long, n_tokens long, target_bits double, background_bits double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, folds: int = 1) -> DataFrame:
    return score(docs, fit(docs, target_ids, folds=folds))
