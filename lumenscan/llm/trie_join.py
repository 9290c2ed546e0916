"""N-gram Jaccard self-join over a prefix tree, and the groups that its links form.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. All sets are ordered globally: tokens
with a lower count first, then by hash; counts come from a sketch of fixed size over all documents (any fixed
order gives the same links, the counts only keep common passages out of the prefixes).

1. Equal sets are one class from the start, named by 64 bits of a digest of the set.
2. Two sets that reach the threshold share a token among the first n - ceil(t n) + 1 of either (the top of the
   prefix tree). These tokens are dealt by ranges of hashes, whose number follows the tokens; a streaming pass over the
   ranges keeps the tokens that two classes or more hold.
3. Each class is first compared with the class that heads most of its runs (a star, so a group of k near copies costs
   k, not k^2), then, in a few rounds, the classes that are still apart with some neighbours in their shuffled runs.
   These two steps only save work, so they pass over pairs whose min-hash sketches are far apart. Every round's links
   contract the components found before it, so later rounds work on roots. Then every pair of classes that share a
   prefix token but are still in different components is a candidate, so that no link between components is lost.
4. Remaining-length bounds rule candidates out before any set is sent. From the first shared token on, with i and j
   tokens before it, no more than min(n - i, m - j) tokens can be common. And with c common prefix tokens of sets of
   n >= m tokens, no more than c + ceil(t n) - 1 can be: what is shared up to the earlier end of the two prefixes is among
   the c, and behind it stand at most ceil(t n) - 1 tokens of the set whose prefix ends there. Bitmaps of the shared
   prefix tokens bound c from above: each bit that only one set has stands for a token or more that the other lacks.
5. Comparing: for one set, the sets of its candidates form a trie (ranges of sorted sequences). It is walked from the
   root; the partial overlap up to a node is computed once for all sets below it, and a whole subtree is left as soon as
   its longest remainder cannot reach the smallest overlap that any set in it needs.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five words is
one shingle; a text of any length is read whole; equal texts are one class; a null doc_id gets a row and no links; a
doc_id that occurs more than once gets a row for each; an empty table gives an empty result; other columns are not
touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bloom
from ._store import discard, free_names, materialize
from ._text import Words, grams, mix, slices
from .components import contracted

SHINGLE = 5
#: The threshold as a fraction, 75 / 100.
NUM, DEN = 75, 100
SKETCH_BITS = 20
_SKETCH_SLICES = 32
#: Prefix tokens that a task works on at once, those in a range of hashes, and the least number of ranges as a power of 2.
BLOCK_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 17
LEAST_RANGE_BITS = 12
#: Tasks that the pairs of one class are dealt to.
SALTS = 16
#: Rounds over what is still apart, before all that remains is compared, and pairs a class in each.
NEIGHBOUR_ROUNDS = 4
PARTNERS = 6
#: A further round follows one in which such a share of the pairs were links; the last step finds what is left in any case.
WORTH = 0.1
#: Bins of a class's min-hash sketch, and the share of equal bins below which the saving steps leave a pair to the last one.
SKETCH_BINS = 64
SKETCH_LEAST = 0.6
#: Bits of a class's bitmap of its shared prefix tokens; any number gives the same links, more rule out more pairs.
BITMAP = 1024

_SIGNATURES = "doc_id long, n_shingles long, cid long, sketch binary, slice int, part int, counts binary"


def needed_overlap(n: int, m: int) -> int:
    """Smallest intersection size with DEN * inter >= NUM * union."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NUM * n // DEN) + 1


def distinct(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct tokens; for short arrays faster than numpy's own."""
    tokens = np.sort(tokens)
    fresh = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
    return tokens[fresh]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, in order."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        windows = grams(words.hash, SHINGLE)
        for first, count in zip(words.first[:-1], words.count):
            if count >= SHINGLE:
                yield distinct(windows[first : first + count - SHINGLE + 1])
            elif count:
                yield mix(grams(words.hash[first : first + count], int(count)) + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def class_id(tokens: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(np.ascontiguousarray(tokens).view(np.uint8))
    return h - (1 << 64) if h >> 63 else h


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Per sorted set (a row) the smallest token of each range of hashes as a byte from 1 to 255; 0: none there."""
    out = np.zeros(len(sets) * SKETCH_BINS, np.uint8)
    if sets:
        tokens = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * SKETCH_BINS + (tokens >> np.uint64(64 - (SKETCH_BINS - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[first]] = (mix(tokens[first]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.reshape(-1, SKETCH_BINS)


def look_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches (a row each) agree in SKETCH_LEAST of the bins that either fills; few filled bins tell nothing."""
    filled = ((x > 0) | (y > 0)).sum(axis=1)
    return (filled < SKETCH_BINS // 2) | (((x == y) & (x > 0)).sum(axis=1) >= SKETCH_LEAST * filled)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("sketch", pa.binary()), ("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    some = False
    for batch in batches:
        some = True
        sets = list(shingle_sets(batch.column(1)))
        if sets:
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        n, rows = len(sets), sketches(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([class_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([row.tobytes() if len(x) else None for x, row in zip(sets, rows)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            schema=schema,
        )
    if some:
        blobs = [zstandard.compress(x.tobytes(), 1) for x in np.split(counts, _SKETCH_SLICES)]
        k = len(blobs)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(blobs, pa.binary())], schema=schema
        )


def _levels(signatures: DataFrame) -> np.ndarray:
    """log2 of the sketch's counts: 2^SKETCH_BITS bytes, whatever the data. Summed in two steps, so no task gets every part."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // _SKETCH_SLICES, np.uint64)
        for blob in frame["counts"]:
            part = zstandard.decompress(blob)
            total += np.frombuffer(part, np.uint32 if len(part) == total.size * 4 else np.uint64)
        return pd.DataFrame({"slice": frame["slice"][:1], "counts": [zstandard.compress(total.tobytes(), 1)]})

    parts = signatures.filter("slice is not null").select("slice", "part", "counts")
    once = parts.groupBy("slice", F.expr("part div 256")).applyInPandas(lambda key, f: add(f), "slice int, counts binary")
    rows = once.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    total = np.zeros((_SKETCH_SLICES, (1 << SKETCH_BITS) // _SKETCH_SLICES), np.uint64)
    for row in rows:
        total[row["slice"]] = np.frombuffer(zstandard.decompress(bytes(row["counts"])), np.uint64)
    return np.floor(np.log2(np.maximum(total.reshape(-1), 1))).astype(np.uint8)


def _ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """By level, then by hash: tokens come sorted, so a stable sort by level is enough."""
    return tokens[np.argsort(levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def _prefixes(levels_blob, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, rows): the prefix tokens of some classes that lie in one of 2^bits ranges of hashes, as a matrix of
    (token, class, size << 32 | position), so that a shuffle moves blocks and not single tokens."""
    levels = np.frombuffer(zstandard.decompress(levels_blob.value), np.uint8)
    seen: set[int] = set()
    tok: list[np.ndarray] = []
    cid: list[np.ndarray] = []
    at: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        rows = np.stack([np.concatenate(tok), np.concatenate(cid).view(np.uint64), np.concatenate(at).view(np.uint64)], axis=1)
        rows = rows[np.argsort(rows[:, 0])]
        of = rows[:, 0] >> np.uint64(64 - bits)
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        blobs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 24).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int64)), blobs], names=["range", "rows"])

    for batch in batches:
        if len(seen) > 200_000:
            seen.clear()
        for tokens in shingle_sets(batch.column(0)):
            if not len(tokens) or (c := class_id(tokens)) in seen:
                continue
            seen.add(c)
            p = int(prefix_length(len(tokens)))
            tok.append(_ordered(tokens, levels)[:p])
            cid.append(np.full(p, c, np.int64))
            at.append(np.arange(p, dtype=np.int64) | len(tokens) << 32)
            held += p
            if held >= BLOCK_TOKENS:
                yield flush()
                tok, cid, at, held = [], [], [], 0
    if held:
        yield flush()


def _runs(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks sorted by range: the rows (tok, cid, n, pos) of tokens that two classes or more hold, each with the
    smallest class of its run as far as read (rep) and that class's size.

    Streams: of the range that goes on, only one row a token is carried over, that of its smallest class. Rows that come
    again after such a step may be handed on twice, which later steps allow."""
    carry, carry_sent = np.zeros((0, 3), np.uint64), np.zeros(0, bool)
    waiting: list[np.ndarray] = []
    held = 0

    def settle(last: bool) -> pa.RecordBatch | None:
        nonlocal carry, carry_sent
        rows = np.concatenate([carry, *waiting])
        sent = np.zeros(len(rows), bool)
        sent[: len(carry)] = carry_sent
        order = np.lexsort((~sent, rows[:, 1].view(np.int64), rows[:, 0]))
        rows, sent = rows[order], sent[order]
        new_tok = np.ones(len(rows), bool)
        new_tok[1:] = rows[1:, 0] != rows[:-1, 0]
        fresh = new_tok.copy()
        fresh[1:] |= rows[1:, 1] != rows[:-1, 1]
        rows, sent, starts = rows[fresh], sent[fresh], np.flatnonzero(new_tok[fresh])
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        mixed = np.diff(np.append(starts, len(rows))) > 1
        emit = np.flatnonzero(mixed[run] & ~sent)
        goes_on = np.zeros(len(starts), bool) if last else rows[starts, 0] >> np.uint64(64 - bits) == rows[-1, 0] >> np.uint64(64 - bits)
        carry, carry_sent = rows[starts[goes_on]], (mixed | sent[starts])[goes_on]
        if not len(emit):
            return None
        own, heads = rows[emit], rows[starts[run[emit]]]
        size = lambda r: (r[:, 2] >> np.uint64(32)).astype(np.int32)
        columns = [own[:, 0].view(np.int64), own[:, 1].view(np.int64), size(own), (own[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int32), heads[:, 1].view(np.int64), size(heads)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["tok", "cid", "n", "pos", "rep", "rep_n"])

    for batch in batches:
        for blob in batch.column(1):
            waiting.append(np.frombuffer(blob.as_buffer(), np.uint64).reshape(-1, 3))
            held += len(waiting[-1])
            if held >= BLOCK_TOKENS:
                if (out := settle(False)) is not None:
                    yield out
                waiting, held = [], 0
    if (waiting or len(carry)) and (out := settle(True)) is not None:
        yield out


def walk_trie(probe: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether each set reaches the threshold with the probe, a sorted array.

    The sets, as sequences in one global order, are sorted, so a node of their trie is a range of them that share their
    first `depth` tokens; its overlap with the probe is known when the node is reached."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    seqs = [sets[i] for i in order]
    size = np.array([len(s) for s in seqs], np.int64)
    n = len(probe)
    need = -(-NUM * (n + size) // (NUM + DEN))
    good = np.zeros(len(seqs), bool)
    nodes = [(0, len(seqs), 0, 0)] if seqs and n else []
    while nodes:
        lo, hi, depth, common = nodes.pop()
        if common + min(n - common, int(size[lo:hi].max()) - depth) < int(need[lo:hi].min()):
            continue  # the whole subtree
        a, b = seqs[lo], seqs[hi - 1]
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:k] != b[depth:k])
        end = depth + int(differ[0]) if len(differ) else k
        if end > depth:
            part = a[depth:end]
            common += int(np.count_nonzero(probe[np.minimum(np.searchsorted(probe, part), n - 1)] == part))
        while lo < hi and size[lo] == end:  # sets that end at this node
            good[lo] = common >= need[lo]
            lo += 1
        if lo < hi:
            branch = np.array([s[end] for s in seqs[lo:hi]])
            cuts = [lo, *(lo + 1 + np.flatnonzero(branch[1:] != branch[:-1])).tolist(), hi]
            nodes += [(i, j, end, common) for i, j in zip(cuts[:-1], cuts[1:])]
    found = np.zeros(len(sets), bool)
    found[order] = good
    return found


def _packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return np.ascontiguousarray((tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(blob: pa.Scalar) -> np.ndarray:
    out = np.zeros((len(blob.as_buffer()) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, tokens) sorted by a and salt, a's own set first: the pairs that link. Keeps one set only."""
    at: tuple[int, int] | None = None
    probe = np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, b = (batch.column(k).to_numpy() for k in range(3))
        good = np.zeros(len(a), bool)
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(a)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if at != (a[i], salt[i]):
                at, probe = (a[i], salt[i]), np.sort(_unpacked(batch.column(3)[i]))
                i += 1
            rows = [k for k in range(i, j) if b[k] != a[k]]
            good[rows] = walk_trie(probe, [_unpacked(batch.column(3)[k]) for k in rows])
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], names=["a", "b"])


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select("b", "a"))


class JaccardJoin:
    """The join over one table; `documents()` and `links()` are its results."""

    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id"):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        signed = materialize(self.docs.mapInArrow(_signatures, _SIGNATURES), "signatures")
        self.rows = signed.filter("slice is null").select("doc_id", "n_shingles", "cid")
        named = signed.filter("cid is not null and doc_id is not null")
        self.classes = materialize(named.groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min("sketch").alias("sketch")), "classes")
        levels = _levels(signed)
        # a fixed 2^SKETCH_BITS bytes
        blob = self.spark.sparkContext.broadcast(zstandard.compress(levels.tobytes()))
        # ranges of hashes of about RANGE_TOKENS prefix tokens, however many there are
        tokens = (self.rows.agg(F.sum("n_shingles")).first()[0] or 0) * (DEN - NUM) // DEN
        bits = max(LEAST_RANGE_BITS, (tokens // RANGE_TOKENS).bit_length())
        prefixes = self.docs.filter("doc_id is not null").select("text").mapInArrow(lambda b: _prefixes(blob, bits, b), "range long, rows binary")
        runs = prefixes.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: _runs(bits, b), "tok long, cid long, n int, pos int, rep long, rep_n int")
        self.runs = materialize(runs, "runs")
        self.blob = blob
        self._links: DataFrame | None = None
        self._labels: DataFrame | None = None

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that reach the threshold.

        A class's set is read from its first document and sent twice: to its pairs, then with them to a. The pairs of
        one a are dealt to SALTS tasks at most, a's own set going to each."""
        dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
        own = dealt.select("a", F.col("a").alias("b"), "salt").distinct()
        wanted = materialize(dealt.union(own).join(self.classes.select(F.col("cid").alias("b"), "first_id"), "b").select("a", "b", "salt", "first_id"), "wanted")
        packed = self.spark.sparkContext.broadcast(_bloom.build(wanted, "first_id"))
        blob = self.blob

        def pack(batches):
            keep, levels = _bloom.Filter(packed.value), np.frombuffer(zstandard.decompress(blob.value), np.uint8)
            for batch in batches:
                batch = batch.filter(pa.array(keep.may_have(batch.column(0).to_numpy())))
                sets = list(shingle_sets(batch.column(1)))
                # common tokens first in the sequence
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([class_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([_packed(_ordered(x, levels)[::-1]) for x in sets], pa.binary())], names=["doc_id", "cid", "tokens"])

        sets = self.docs.filter("doc_id is not null").mapInArrow(pack, "doc_id long, cid long, tokens binary")
        rows = sets.join(wanted, (sets.doc_id == wanted.first_id) & (sets.cid == wanted.b)).select("a", "salt", "b", "tokens")
        ranked = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
        return materialize(ranked.mapInArrow(_verify, "a long, b long"), "links")

    def _promising(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches are alike; the others are left to the last step."""

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH_BINS) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(look_alike(x, y)))

        x, y = (self.classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"of_{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(alike, "a long, b long")

    def _star(self) -> DataFrame:
        """For every class the one class that heads most of its runs: at most a pair a class."""
        fits = F.expr(f"cid <> rep and {NUM} * greatest(n, rep_n) <= {DEN} * least(n, rep_n)")
        votes = self.runs.filter(fits).groupBy(F.col("rep").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
        return materialize(self._promising(votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")), "pairs")

    def _neighbours(self, open_runs: DataFrame, k: int) -> DataFrame:
        """For every class at most PARTNERS classes of other components, those that stand next to it in most of its runs
        when each run is shuffled by a hash."""
        shuffled = Window.partitionBy("tok").orderBy(F.xxhash64("cid", F.lit(k), F.col("tok") % 4))
        beside = open_runs.select("cid", "root", "n", *(F.lag(c).over(shuffled).alias(f"last_{c}") for c in ("cid", "root", "n")))
        fits = F.expr(f"root <> last_root and {NUM} * greatest(n, last_n) <= {DEN} * least(n, last_n)")
        votes = beside.filter(fits).groupBy(F.greatest("cid", "last_cid").alias("b"), F.least("cid", "last_cid").alias("a")).agg(F.count(F.lit(1)).alias("votes"))
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("votes"), "a"))
        return self._promising(votes.withColumn("rank", best).filter(F.col("rank") <= PARTNERS).select("a", "b"))

    def _open_runs(self, runs: DataFrame, labels: DataFrame) -> DataFrame:
        """The runs that classes of different components share, with their roots; a later round starts from the last one's."""
        runs = runs.select("tok", "cid", "n", "pos").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("tok", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"))
        of_run = Window.partitionBy("tok")
        return materialize(runs.select("*", F.min("root").over(of_run).alias("lo"), F.max("root").over(of_run).alias("hi")).filter("lo <> hi").drop("lo", "hi"), "open-runs")

    def _candidates(self, open_runs: DataFrame) -> DataFrame:
        """Every pair of classes of different components that the remaining-length bounds leave."""
        x, y = open_runs.alias("x"), open_runs.alias("y")
        fits = f"x.tok = y.tok and x.cid < y.cid and x.root <> y.root and {NUM} * greatest(x.n, y.n) <= {DEN} * least(x.n, y.n)"
        first = f"{NUM + DEN} * least(x.n - x.pos, y.n - y.pos) >= {NUM} * (x.n + y.n)"
        pairs = x.join(y, F.expr(f"{fits} and {first}")).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).distinct()
        word = lambda k: F.expr(f"bit_or(if(shiftright(tok, 6) & {BITMAP // 64 - 1} = {k}, shiftleft(1L, cast(tok & 63 as int)), 0L))").alias(f"w{k}")
        marks = open_runs.groupBy("cid").agg(F.count(F.lit(1)).alias("p"), *(word(k) for k in range(BITMAP // 64)))
        x, y = (marks.select(F.col("cid").alias(c), F.col("p").alias(f"p_{c}"), F.array(*(f"w{k}" for k in range(BITMAP // 64))).alias(f"w_{c}")) for c in "ab")
        lacks = lambda c, d: " + ".join(f"bit_count(w_{c}[{k}] & ~w_{d}[{k}])" for k in range(BITMAP // 64))
        common = f"least(p_a - ({lacks('a', 'b')}), p_b - ({lacks('b', 'a')}))"
        return pairs.join(x, "a").join(y, "b").filter(f"{common} + ceil({NUM} * greatest(n, m) / {DEN}D) - 1 >= ceil({NUM} * (n + m) / {NUM + DEN}D)").select("a", "b")

    def links(self) -> DataFrame:
        """Verified pairs (a, b) of class ids that join all classes of a component; not every pair within one."""
        if self._links is None:
            tried = self._star()
            links = self._verified(tried)
            labels = contracted(None, links)
            open_runs = self._open_runs(self.runs, labels)
            for k in range(NEIGHBOUR_ROUNDS):
                again = materialize(self._neighbours(open_runs, k).join(_both(tried), ["a", "b"], "left_anti"), "pairs")
                tried, more = tried.union(again), self._verified(again)
                links, labels = links.union(more), contracted(labels, more)
                before, open_runs = open_runs, self._open_runs(open_runs, labels)
                discard(before)
                if more.count() < WORTH * again.count():
                    break
            last = materialize(self._candidates(open_runs).join(_both(tried), ["a", "b"], "left_anti"), "pairs")
            discard(open_runs)
            if not last.isEmpty():
                more = self._verified(last)
                links, labels = links.union(more), contracted(labels, more)
            self._links, self._labels = links, labels
        return self._links

    def documents(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
        self.links()
        named = self.classes.join(self._labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first_id", F.coalesce("root", "cid").alias("root"))
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        by_class = named.join(least, "root").select("cid", "component_id")
        return self.rows.join(by_class, "cid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return JaccardJoin(docs, text_col, id_col).documents()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns."""
    found = near_duplicates(docs).filter("doc_id = component_id or doc_id is null")
    (own,) = free_names(docs, "kept")
    return docs.join(found.select(F.col("doc_id").alias(own)).distinct(), docs.doc_id.eqNullSafe(F.col(own)), "left_semi")
