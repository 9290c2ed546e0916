"""A knowledge base: documents split by a hierarchy of separators, kept by version of their source, searched by cosine.

The store is a folder of Parquet files that only grows: what is put in carries a version, and of each source the newest version
holds. Removing a source puts in a version without chunks. A writer that fails leaves what was there."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import nearest
from .warehouse import scratch, written

SIZE, OVERLAP, DIMENSIONS, TOP = 1000, 200, 768, 4
SLICE = 512
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNKS = "source string, doc_id long, chunk_no int, chunk string, embedding array<float>"


def _runs(text: str, low: int, high: int, size: int, level: int = 0) -> Iterator[list[int]]:
    """Runs of short pieces of text[low:high], each as the offsets of its pieces. A piece of `size` or more is cut by the next separator
    and ends the run before it."""
    while SEPARATORS[level] and SEPARATORS[level] not in text[low:high]:
        level += 1
    mark = SEPARATORS[level]
    cuts = [low, *(m.start() for m in re.finditer(re.escape(mark), text[low:high]))] if mark else [*range(low, high)]
    if mark:
        cuts[1:] = [low + c for c in cuts[1:]]
    cuts = sorted({*cuts, high})
    run = [low]
    for start, end in zip(cuts, cuts[1:]):
        if end - start < size:
            run.append(end)
            continue
        if len(run) > 1:
            yield run
        yield from _runs(text, start, end, size, level + 1)
        run = [end]
    if len(run) > 1:
        yield run


def split(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `size` characters. Pieces keep the separator before them; of a chunk's last pieces as many as fit into
    `overlap` open the next one. White space around a chunk goes, and with it empty ones."""
    out: list[str] = []
    if not text:
        return out
    for run in _runs(text, 0, len(text), size):
        first = 0
        for last in range(1, len(run)):
            if run[last] - run[first] > size:
                if last - 1 > first:
                    out.append(text[run[first] : run[last - 1]].strip())
                while run[last - 1] - run[first] > overlap or (run[last] - run[first] > size and last - 1 > first):
                    first += 1
        out.append(text[run[first] : run[-1]].strip())
    return [c for c in out if c]


def embed(text: str) -> np.ndarray:
    """Counts of words by hash, in DIMENSIONS places; never all zero."""
    at = [zlib.crc32(w.encode()) % DIMENSIONS for w in re.findall(r"\w+", text.lower())]
    return np.bincount(at or [0], minlength=DIMENSIONS).astype(np.float32)


def _vectors(texts: list[str]) -> pa.Array:
    """Their vectors, in one flat array."""
    flat = np.concatenate([embed(t) for t in texts])
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * DIMENSIONS, flat)


def sliced(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of source, doc_id and text, SLICE at a time, as vectors take more room than their texts."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for batch in batches:
        source, doc_id, texts = (batch.column(k) for k in range(3))
        cut = ((row, k, c) for row in range(batch.num_rows) for k, c in enumerate(split(texts[row].as_py() or "", size, overlap)))
        while some := list(islice(cut, SLICE)):
            rows, places, held = zip(*some)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([source.take(at), doc_id.take(at), pa.array(places, pa.int32()), pa.array(held, pa.string()), _vectors(held)], names=names)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with their vectors of docs with doc_id, source and text; null and empty texts have none. A narrow pass."""
    return docs.select("source", F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: sliced(batches, size, overlap), CHUNKS)


def _newest(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # nothing has been put in yet
        return 0


def put(docs: DataFrame, path: str) -> None:
    """Replaces the sources that `docs` hold; a source whose documents have no chunks is there without any."""
    version = _newest(docs.sparkSession, path) + 1
    known = docs.select("source").filter("source is not null").distinct()
    named = known.select("source", *(F.lit(None).cast(kind.split(maxsplit=1)[1]).alias(kind.split()[0]) for kind in CHUNKS.split(", ")[1:]))
    rows = chunks(docs.filter("source is not null")).unionByName(named)
    rows.withColumn("version", F.lit(version)).withColumn("removed", F.lit(False)).write.mode("append").parquet(path)


def remove(spark: SparkSession, path: str, *sources: str) -> None:
    gone = spark.createDataFrame([(s,) for s in sources], "source string")
    named = gone.select("source", *(F.lit(None).cast(kind.split(maxsplit=1)[1]).alias(kind.split()[0]) for kind in CHUNKS.split(", ")[1:]))
    named.withColumn("version", F.lit(_newest(spark, path) + 1)).withColumn("removed", F.lit(True)).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each source's newest version; a source without chunks has one row with a null chunk.

    The versions are written, so that their size is known before the join: where sources are few, vectors are not dealt by source."""
    rows = spark.read.parquet(path)
    newest = written(rows.groupBy("source").agg(F.max("version").alias("version")), "kb-newest")
    return rows.join(newest, ["source", "version"], "left_semi").filter("not removed")


def sources(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path).groupBy("source", "version").agg(F.count_distinct("doc_id").alias("n_docs"))


def retrieve(questions: DataFrame, path: str, top: int = TOP) -> DataFrame:
    """q_id, context, sources: the `top` nearest chunks of each question (q_id, text), best first, told with their sources."""
    spark = questions.sparkSession
    held = current(spark, path).filter("chunk is not null").select("source", "doc_id", "chunk_no", "chunk", "embedding")
    # an id of its own for each chunk; written, so that it holds. Questions have negative ids.
    folder = scratch(spark, "kb-ids")
    held.withColumn("vec_id", F.monotonically_increasing_id()).write.parquet(folder)
    stored = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), _vectors([t or "" for t in part.column(1).to_pylist()])], names=["vec_id", "embedding"])

    asked = questions.select((-F.col("q_id") - 1).cast("long").alias("vec_id"), "text").mapInArrow(run, "vec_id long, embedding array<float>")
    # written for its size, as above: the texts of all chunks are dealt only to answers that are many
    near = written(nearest(stored.select("vec_id", "embedding"), asked, top), "kb-near")
    found = stored.select("vec_id", "source", "chunk").join(near, "vec_id")
    best = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "vec_id", "source", "chunk")))
    rows = found.groupBy((-F.col("q_id") - 1).alias("q_id")).agg(best.alias("b"))
    told = F.transform("b", lambda x: F.concat(F.lit("Source: "), x["source"], F.lit("\nContent: "), x["chunk"]))
    return rows.select("q_id", F.array_join(told, "\n\n---\n\n").alias("context"), F.array_sort(F.array_distinct(F.col("b.source"))).alias("sources"))
