"""How filters interact: what each of five filters removes in each of the 120 orders they can be applied in.

Four filters look at one text; one narrow pass gives their failures as bits, with the text's length in code points and the
hashes of successive blocks. The fifth removes repeated texts, which partition refinement finds: texts are split by
length, then by the hash of one block after another, and every class with a single row is dropped before the next block
is looked at. The texts that are left are compared whole. Equal texts of one task are combined before any shuffle, so a
large group of copies never meets in one task. Non-minimum ids of a class carry the fifth bit; documents are then counted
by (part, bits, labels), at most 128 rows a part, and every order is worked out from these counts.

Defined cases: a null text is empty (fails A only, and E like any repeated text); a null `lang` is the part ''. A row with
a null doc_id has no smaller or larger one: it never fails E and makes no other row fail. Rows of one doc_id with equal
texts are not each other's copies. A doc_id with several labels has quality or toxic 1 if any of them has; labels without
a doc_id count for nothing. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bloom import Filter, build
from ._store import discard, materialize

FILTERS = "ABCDE"
#: Ends, in bytes, of the blocks that are hashed one after another; a longer text has one more block, its rest.
BLOCKS = (256, 4096, 65536)
#: Words are split off so many bytes at a time, so a huge text is never held as words.
PIECE = 1 << 20
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SYMBOL = bytes(set(range(256)) - set(b"#$%&*|"))
LEDGER = "doc_id long, part string, bits int, length long, chain array<long>"


def _words(raw: bytes) -> tuple[int, int]:
    """Number of words and of distinct words; bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    if len(raw) <= PIECE:
        words = raw.split()
        return len(words), len(set(words))
    count, distinct, at = 0, set(), 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = raw[at:end].split()
        count += len(words)
        distinct.update(words)
        at = end
    return count, len(distinct)


def chain(raw: bytes, bits: int = 64) -> list[int]:
    """A hash after each block, of everything up to its end."""
    state, out, at = xxhash.xxh3_64(), [], 0
    for end in (*(b for b in BLOCKS if b < len(raw)), len(raw)):
        state.update(raw[at:end])
        out.append((state.intdigest() & ((1 << bits) - 1)) - (1 << 63 if bits == 64 else 0))
        at = end
    return out


def measure(raw: bytes, length: int) -> int:
    """Failure bits A to D."""
    n, distinct = _words(raw)
    upper = len(raw.translate(None, _NOT_UPPER))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * upper > 10 * length) << 2 | (symbols > 0) << 3


def _texts(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    column = column.fill_null("") if column.null_count else column
    return [x.as_buffer().to_pybytes() if x.as_buffer() else b"" for x in column], pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def ledger(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part, failure bits, length and block hashes of every row, without a shuffle."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, lengths = _texts(batch.column(2))
            failed = pa.array([measure(r, int(n)) for r, n in zip(raws, lengths)], pa.int32())
            chains = pa.array([chain(r, bits) for r in raws], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, pa.array(lengths), chains], names=["doc_id", "part", "bits", "length", "chain"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(measured, LEDGER)


def _last(column: str = "chain") -> Column:
    return F.element_at(column, -1)


def refine(rows: DataFrame) -> DataFrame:
    """(length, chain) of the texts that share their length and all block hashes with another row. `rows` is a ledger.

    Each round splits the classes left by one more block and drops single rows, so later rounds see fewer. The first
    aggregation has combined copies: what a round joins are different texts, and a class that many of them share (one
    length) is an ordinary skewed join side, which Spark splits."""
    left = materialize(rows.groupBy("length", "chain").agg(F.count(F.lit(1)).alias("n")), "classes")
    for k in range(len(BLOCKS) + 2):
        keyed = left.withColumn("key", F.col("length") if k == 0 else F.get("chain", F.least(F.lit(k), F.size("chain")) - 1))
        shared = keyed.groupBy("length", "key").agg(F.sum("n").alias("m")).filter("m > 1").select("length", "key")
        split = materialize(keyed.join(shared, ["length", "key"], "left_semi").select("length", "chain", "n"), "classes")
        discard(left)
        left = split
    return left


def colliding(docs: DataFrame, shared: DataFrame, bits: int = 64) -> DataFrame:
    """Compares the texts left by refinement whole: the (length, last hash) under which more than one text was found.

    A Bloom filter over the classes, of 16 bits a class (2^27 at most), lets rows pass that may belong to one; a wrong pass
    costs a comparison with nobody."""
    packed = build(shared.select(_last().alias("last")), "last", min(27, max(16, (16 * shared.count()).bit_length())))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Filter(packed)
        for batch in batches:
            raws, lengths = _texts(batch.column(0))
            last = np.array([chain(r, bits)[-1] for r in raws], np.int64)
            passed = pa.array(wanted.may_have(last)) if len(raws) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(last), batch.column(0).fill_null("")], names=["length", "last", "text"]).filter(passed)

    texts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(candidates, "length long, last long, text string")
    return texts.distinct().groupBy("length", "last").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")


def mask_counts(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """Documents by part, failure bits (E included) and labels. `bits` shortens the block hashes, for tests of collisions."""
    rows = materialize(ledger(docs, bits), "filter-ledger")
    shared = refine(rows)
    several = materialize(colliding(docs, shared, bits), "colliding")
    discard(shared)
    named = rows.select("doc_id", "part", "bits", "length", _last().alias("last"), F.lit(None).cast("string").alias("text"))
    if not several.isEmpty():  # different texts under one hash: there the text itself names the class
        def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws, lengths = _texts(batch.column(2))
                failed = pa.array([measure(r, int(n)) for r, n in zip(raws, lengths)], pa.int32())
                last = pa.array([chain(r, bits)[-1] for r in raws], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, pa.array(lengths), last, batch.column(2).fill_null("")], names=["doc_id", "part", "bits", "length", "last", "text"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
        apart = texts.mapInArrow(told_apart, "doc_id long, part string, bits int, length long, last long, text string")
        named = named.join(several, ["length", "last"], "left_anti").unionByName(apart.join(several, ["length", "last"], "left_semi"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    labelled = named.filter("doc_id is not null").join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    labelled = labelled.unionByName(named.filter("doc_id is null").withColumns({"good": no, "toxic": no}))
    # rows of one doc_id together, then classes by what is counted: a group of copies is a few rows from here on
    per_id = labelled.groupBy("doc_id", "part", "bits", "length", "last", "text", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    kinds = per_id.groupBy("length", "last", "text", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("n_ids"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    lowest = F.min("first.doc_id").over(Window.partitionBy("length", "last", "text"))
    failing = kinds.withColumn("lowest", lowest).withColumn("n_e", F.col("n_ids") - F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("bits").alias("mask"), (F.col("n") - F.col("n_e")).alias("docs")), F.struct((F.col("bits") + 16).alias("mask"), F.col("n_e").alias("docs")))).alias("x")
    return failing.select("part", "good", "toxic", both).groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.docs").alias("docs"))


def _steps() -> list[tuple[int, int]]:
    """Filters applied before, as bits, and the filter at work."""
    return [(before, f) for f in range(5) for before in range(32) if not before >> f & 1]


def orders(counts: DataFrame) -> DataFrame:
    """Every order and step of every part, from the counts: 80 different steps, looked up by the 600 places in the orders."""
    spark = counts.sparkSession
    step = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit")) for b, f in _steps()))).alias("s")
    mask, bit = F.col("mask"), F.col("s.bit")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("s.before")) != 0

    def docs(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("docs")).otherwise(0)).cast("long")

    each = counts.select("part", "mask", "good", "toxic", "docs", step).groupBy("part", "s.before", "s.f").agg(
        docs(~fails & ~earlier).alias("kept"), docs(fails & ~earlier).alias("removed"), docs(fails & earlier).alias("redundant"), docs(mask == bit).alias("unique_fails"),
        docs(fails & ~earlier & F.col("good")).alias("good_lost"), docs(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    # of the 120 orders, |before|! * (4 - |before|)! meet the filter after just these
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(4 - k)) for k in range(5))), F.bit_count("before") + 1)
    each = each.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "f")).cast("long"))
    places = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(5)]
    table = spark.createDataFrame(places, "filter_order string, step int, before int, f int")  # 600 rows
    return each.join(F.broadcast(table), ["before", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(materialize(mask_counts(docs, labels), "mask-counts"))
