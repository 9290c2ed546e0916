"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and, in `failed_bits`,
one bit per failed rule; policies are versioned bit masks applied to the ledger afterwards, and
ablations are bitwise aggregations over it, so no text is read again.

Defined cases: null or empty text has no words and fails `few_words` (and so the base); a null doc_id is
kept as it is; repeated rows give repeated results; further columns of the input are not touched; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, grams, slices

#: Rules by bit. The first two are the base.
RULES = ("few_words", "repeated_words", "symbol_heavy", "repeated_lines", "long_words", "short_words", "shouting", "pipe_lists")
BASE_MASK = 0b11
#: Policies by version: the bits that reject. Single symptoms that clean prose can show reject only from v3 on.
POLICIES = {"v1": BASE_MASK, "v2": 0b01011111, "v3": 0b11111111}
LATEST = "v2"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, failed_bits long"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(words: Words) -> np.ndarray:
    """Per row: words that lie in a 3-word window found at least twice in the same text."""
    rows, doc = len(words.count), words.doc()
    if len(doc) < 3:
        return np.zeros(rows, np.int64)
    window = grams(words.hash, 3)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = window[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twin = np.zeros(len(at), bool)
    twin[1:] |= same
    twin[:-1] |= same
    hit = at[order[twin]]
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[hit + k] = True
    return _per_row(covered, words.first)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a batch."""
    parts: list[dict[str, np.ndarray]] = []
    for _, data, offsets in slices(column):
        words = Words(data, offsets)
        lead = (data & 0xC0) != 0x80
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=upto[1:])
        raw = data.tobytes()
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122))
        breaks = _per_row(data == 10, offsets)
        parts.append(
            {
                "n_words": words.count.astype(np.int64),
                "word_chars": _per_row(upto[words.end] - upto[words.start], words.first),
                "n_symbols": _per_row(_SYMBOL[data], offsets),
                "n_dup_lines": np.array([_duplicate_lines(raw[a:b]) if k else 0 for a, b, k in zip(offsets[:-1], offsets[1:], breaks)], np.int64),
                "n_repeat_words": _repeat_words(words),
                "upper": _per_row(upper, offsets),
                "letters": _per_row(letter, offsets),
                "pipes": _per_row(data == 124, offsets),
            }
        )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "letters", "pipes")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits, by RULES."""
    w = m["n_words"]
    tests = (
        w < 50,
        100 * m["n_repeat_words"] > 50 * w,
        10 * m["n_symbols"] > 3 * w,
        (m["n_dup_lines"] >= 5) & (12 * m["n_dup_lines"] > w),
        m["word_chars"] > 15 * w,
        m["word_chars"] < 2 * w,
        2 * m["upper"] > m["letters"],
        10 * m["pipes"] > 3 * w,
    )
    bits = np.zeros(len(w), np.int64)
    for k, failed in enumerate(tests):
        bits |= failed.astype(np.int64) << k
    return bits


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measure(batch.column(1))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in names), pa.array(failures(m))], names=["doc_id", *names, "failed_bits"])


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: measurements and the failure bits. A narrow pass without a shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_ledger, LEDGER)


def rejects(bits: Column, policy: str = LATEST) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """Adds base_failed and kept."""
    return rows.withColumn("base_failed", rejects(F.col("failed_bits"), "v1")).withColumn("kept", ~rejects(F.col("failed_bits").bitwiseOR(0), policy) & ~rejects(F.col("failed_bits"), "v1"))


def ablations(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were dropped.

    Documents are first counted by their distinct masks (at most 2^rules rows), so one small aggregation serves every rule."""
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if mask >> k & 1)))
    return (
        masks.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep(docs: DataFrame, policy: str = LATEST) -> DataFrame:
    """The documents that the policy keeps, with all their columns, in one narrow pass."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = failures(measure(batch.column(at)))
            yield batch.filter(pa.array(bits & (POLICIES[policy] | BASE_MASK) == 0))

    return docs.mapInArrow(kept, schema)
