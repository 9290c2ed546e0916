"""Token ids in bit-plane files.

A file holds blocks of at most BLOCK ids. A block is transposed into byte planes (or bit planes), so that the high
bytes, mostly equal, stand together; each plane is compressed with zstandard on its own. Behind the blocks stand a
chunk index (offset, ids and plane sizes of every block) and a document table (doc_id, ids), then a fixed trailer:

    b"LPLANES1" | planes of block 0 | planes of block 1 | ... | index | trailer: index size (8), b"LPLANES1"

Numbers are little-endian. One line feed may follow: Spark's text writer puts it there, and with that writer's commit
protocol and `binaryFile` as reader these files live in any store that Spark knows, and a lost task leaves none behind.

Defined cases: null text is empty (the end id alone); null doc_ids stand first; equal doc_ids stand together in the
order of their texts; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import fresh_path, materialize
from .token_counts import encoder

MAGIC = b"LPLANES1"
BLOCK = 1 << 16
FILE_IDS = 8 << 20
_NO_ID = -(1 << 63)


def planes_of(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes of uint32 ids, low byte first, or their 32 bit planes."""
    matrix = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(matrix[:, k]).tobytes() for k in range(4)]
    spread = np.unpackbits(matrix, axis=1, bitorder="little")
    return [np.packbits(spread[:, k]).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        matrix = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        matrix = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(matrix).view("<u4").reshape(-1)


class PlaneWriter:
    def __init__(self, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.block, self.bits, self.pack = block, bits, zstandard.ZstdCompressor(level=level)
        self.parts, self.at, self.index = [MAGIC], len(MAGIC), []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.doc_ids: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(_NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, cut, self.block):
            block = ids[k : min(k + self.block, cut)]
            planes = [self.pack.compress(p) for p in planes_of(block, self.bits)]
            self.index.append([self.at, len(block), [len(p) for p in planes]])
            self.parts += planes
            self.at += sum(map(len, planes))
        self.waiting, self.n_waiting = [ids[cut:]], len(ids) - cut

    def finish(self) -> bytes:
        self._flush(True)
        tables = [self.pack.compress(np.array(x, "<i8").tobytes()) for x in (self.doc_ids, self.sizes)]
        head = json.dumps({"blocks": self.index, "bits": self.bits, "docs": len(self.doc_ids), "tables": [len(t) for t in tables]}).encode()
        index = len(head).to_bytes(8, "little") + head + b"".join(tables)
        return b"".join([*self.parts, index, len(index).to_bytes(8, "little"), MAGIC])


class PlaneReader:
    """Reads a file's blocks by its index; `ids(i, j)` touches only the blocks that hold these ids."""

    def __init__(self, raw: bytes):
        raw = raw[:-1] if raw.endswith(MAGIC + b"\n") else raw
        if raw[: len(MAGIC)] != MAGIC or raw[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a bit-plane file, or cut short")
        self.raw, end = raw, len(raw) - len(MAGIC) - 8
        index = end - int.from_bytes(raw[end : end + 8], "little")
        size = int.from_bytes(raw[index : index + 8], "little")
        head = json.loads(raw[index + 8 : index + 8 + size])
        self.unpack, at = zstandard.ZstdDecompressor(), index + 8 + size
        a, b = head["tables"]
        self.doc_ids = np.frombuffer(self.unpack.decompress(raw[at : at + a]), "<i8") if head["docs"] else np.zeros(0, np.int64)
        self.sizes = np.frombuffer(self.unpack.decompress(raw[at + a : at + a + b]), "<i8") if head["docs"] else np.zeros(0, np.int64)
        self.blocks = head["blocks"]
        self.starts = np.cumsum([0, *(n for _, n, _ in self.blocks)])

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        planes = []
        for s in sizes:
            planes.append(self.unpack.decompress(self.raw[at : at + s]))
            at += s
        return ids_of(planes, n)

    def ids(self, i: int, j: int) -> np.ndarray:
        first, last = np.searchsorted(self.starts, i, "right") - 1, np.searchsorted(self.starts, j, "left")
        if i >= j:
            return np.zeros(0, np.uint32)
        joined = np.concatenate([self.block(k) for k in range(first, last)])
        return joined[i - self.starts[first] : j - self.starts[first]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the file, ids), decoding each block once."""
        start, k, have = 0, 0, np.zeros(0, np.uint32)
        for doc_id, size in zip(self.doc_ids.tolist(), self.sizes.tolist()):
            parts, n = [have], len(have)
            while n < size:
                parts.append(self.block(k))
                n += len(parts[-1])
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else have
            have = joined[size:]
            yield (None if doc_id == _NO_ID else doc_id), start, joined[:size]
            start += size


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, file_ids: int = FILE_IDS, bits: bool = False, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encodes every text, appends end_id, and writes files in ascending doc_id order (file names sort by it)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, end = encoder(tokenizer_path, "ids"), PlaneWriter(bits=bits), np.array([end_id], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, parts in zip(ids, own.all(texts)):
                writer.add(doc_id, np.concatenate([*(np.frombuffer(b"".join(p), np.uint32) for p in parts), end]))
                if writer.n_ids >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["file"])
                    writer = PlaneWriter(bits=bits)
        if writer.doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["file"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ranged.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it, over all files), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "piece", "doc_id", "start_in_file", "n_tokens", "ids_crc32"]
        for batch in batches:
            for k in range(batch.num_rows):
                part, piece = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows = [(doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())) for doc_id, start, ids in PlaneReader(batch.column(2)[k].as_py()).documents()]
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array([piece] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(number(r"^part-(\d+)-").alias("part"), number(r"-c(\d+)\.").alias("piece"), "content")
    rows = files.mapInArrow(run, "part long, piece long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    return rows


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, text_col=text_col, id_col=id_col)
    rows = materialize(read_token_files(spark, path), "token-rows")
    totals = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("total"))
    # one row per file, not per document
    before = F.coalesce(F.sum("total").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", "piece", before.cast("long").alias("before"))
    return rows.join(offsets, ["part", "piece"]).select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
