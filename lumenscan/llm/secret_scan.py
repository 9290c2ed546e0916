"""Secret scans: base patterns, and formats learnt as probabilistic automata.

1. One narrow pass takes from every whole text the spans of the base patterns and, as candidates, all runs of MIN_CHARS or
   more characters of the labelled values' alphabet.
2. Labelled credentials are the values of the base spans. Per kind, at most FIT_VALUES distinct values (those with the
   smallest hashes) fill, whole, a prefix tree over character classes; states whose continuations and ends cannot be told
   apart (Hoeffding bound, ALPHA) are merged, which leaves a small automaton with probabilities of transitions and of
   ending. The other runs of the same alphabet, whole and with their dots, give the background: an automaton of all of them, and
   one of each shape (which classes and marks a run holds) with its frequency, counted over all documents, so that addresses,
   versions or paths have a rival that knows them. Each is learnt from at most FIT_VALUES distinct runs.
3. Every candidate of every document gets its likelihood, its end included, under each format and the background. One whose
   best format leads by MIN_BITS, and by MIN_BITS_PER_CHAR for each character, is a secret. If the whole run is one, what
   lies outside base spans is of kind `format`; else each part outside them is scored, and then the pieces between its
   dots. Base spans stay as they are.
4. The values of base spans are scored too, by automata that have not seen them: values fall into two halves by hash, and
   each half is scored by what the other one taught. `n_confirmed` counts them: the share of credentials that the formats
   find without the words around them is thus measured in every run.

Defined cases: null and empty texts have no spans; texts of any length are read whole; null doc_ids are kept; repeated rows
give repeated results; equal values are one label; of formats with one lead either may be the best, as only the lead counts;
with no labelled values nothing is added; an empty table gives no rows; other columns are not touched.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("passw", "secret", "token", "api")
MIN_CHARS = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

FIT_VALUES = 1000
#: A shape has an automaton of its own from so many distinct ordinary runs on; one of fewer would only know what is to be judged.
LEAST_OF_SHAPE = 20
ALPHA = 0.05
#: Odds of about 1000 to 1 over ordinary runs, whose likelihood already holds how frequent their shape is.
MIN_BITS = 10.0
MIN_BITS_PER_CHAR = 0.6
MASK = "[SECRET]"

_SPAN = "struct<kind:string, start:int, end:int, value:string>"
_SCORED = "struct<kind:string, start:int, end:int, value:string, confirmed:boolean>"
FOUND = f"doc_id long, spans array<{_SPAN}>, candidates array<struct<start:int, end:int, value:string>>, ordinary array<struct<shape:string, value:string>>, shapes array<struct<shape:string, n:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
_SCORED_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confirmed", pa.bool_())]))
_ORDINARY_TYPE = pa.list_(pa.struct([("shape", pa.string()), ("value", pa.string())]))
_SHAPE_TYPE = pa.list_(pa.struct([("shape", pa.string()), ("n", pa.int64())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, credential) of the base patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]


def outside(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers."""
    out = []
    for a, b in sorted(covered):
        if b <= start or a >= end:
            continue
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def added(start: int, value: str, covered: list[tuple[int, int]], secret: Callable[[str], bool]) -> list[tuple[int, int]]:
    """The spans of a candidate that the formats add to the base spans."""
    parts = outside(start, start + len(value), covered)
    if parts and secret(value):
        return parts
    out = []
    for a, b in parts:
        part = value[a - start : b - start]
        if len(part) < MIN_CHARS:
            continue
        if part != value and secret(part):
            out.append((a, b))
        elif "." in part:
            out += [(a + m.start(), a + m.end()) for m in re.finditer(r"[^.]+", part) if len(m[0]) >= MIN_CHARS and secret(m[0])]
    return out


#: Character classes; a class's probability is shared evenly among its characters.
_CLASS = {**{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}}
_SHARE = {"h": 6, "l": 20, "U": 26, "9": 10}
#: What can follow a state: the four classes, the six marks of the values' alphabet, the end.
_NEXT = 11
_END = "$"


def classes(value: str) -> str:
    return "".join(_CLASS.get(c, c) for c in value)


def shape(value: str) -> str:
    """Which classes and marks a value holds; there are at most 2^10 of them."""
    return "".join(sorted(set(classes(value))))


class Automaton:
    """A deterministic automaton with probabilities, merged from the prefix tree of its examples."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.total: list[int] = [0]
        for value in values:
            state = 0
            for c in [*classes(value), _END]:
                self.total[state] += 1
                self.seen[state][c] = self.seen[state].get(c, 0) + 1
                if c == _END:
                    break
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.total.append(0)
                state = self.next[state][c]
        self._merge(alpha)

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether no continuation of one state is significantly more frequent than that of the other, at any depth."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # nor can states below, which have fewer examples, be told apart
            if any(abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > bound for c in self.seen[a].keys() | self.seen[b].keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.total[a] += self.total[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self, alpha: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            source, c = blue.pop(0)
            state = self.next[source].get(c)
            if state is None or state in red:
                continue
            for r in red:
                if self._alike(r, state, alpha):
                    self.next[source][c] = r
                    self._fold(r, state)
                    blue += [(r, x) for x in sorted(self.next[r]) if self.next[r][x] not in red and (r, x) not in blue]
                    break
            else:
                red.append(state)
                blue += [(state, x) for x in sorted(self.next[state])]
        self.red = red

    def bits(self, value: str) -> float:
        """log2 of the likelihood of the value and its end; what a state has not seen shares what smoothing leaves."""
        state, out = 0, 0.0
        for c in [*classes(value), _END]:
            p = (self.seen[state].get(c, 0) + 0.05) / (self.total[state] + 0.05 * _NEXT)
            out += math.log2(p / _SHARE.get(c, 1))
            state = self.next[state].get(c, 0)
        return out


def _half(value: str) -> int:
    return hashlib.md5(value.encode()).digest()[15] & 1


class Formats:
    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], counts: dict[str, int] | None = None):
        """ordinary: examples of unlabelled runs. counts: how often runs of a shape occur, else as often as in the examples."""
        learn = lambda half: [Automaton(some) for v in labelled.values() if (some := [x for x in v if half is None or _half(x) != half])]
        self.formats = learn(None)
        self.held_out = learn(0), learn(1)
        pools: dict[str, tuple[list[str], int]] = {}
        by_shape: dict[str, list[str]] = {}
        for value in ordinary:
            by_shape.setdefault(shape(value), []).append(value)
        frequency = {k: (counts or {}).get(k, len(v)) for k, v in by_shape.items()}
        total = sum(frequency.values())
        self.ordinary = [(0.0, Automaton(heapq.nsmallest(FIT_VALUES, ordinary, key=_order)))]
        self.ordinary += [(math.log2(frequency[k] / total), Automaton(v)) for k, v in by_shape.items() if len(v) >= LEAST_OF_SHAPE]

    def background(self, value: str) -> float:
        """log2 of the likelihood of the value among ordinary runs: under the automaton of all of them, or under that of one shape and the
        shape's frequency, whichever knows it better."""
        return max(share + a.bits(value) for share, a in self.ordinary)

    def _leads(self, formats: list[Automaton], value: str) -> bool:
        if not formats:
            return False
        lead = max(a.bits(value) for a in formats) - self.background(value)
        return lead >= MIN_BITS and lead >= MIN_BITS_PER_CHAR * len(value)

    def secret(self, value: str) -> bool:
        return self._leads(self.formats, value)

    def confirmed(self, value: str) -> bool:
        """Whether formats learnt from other values than this one's half find it."""
        return self._leads(self.held_out[_half(value)], value)


def _order(value: str) -> tuple[str, str]:
    return hashlib.md5(value.encode()).hexdigest(), value


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, others, ordinary, counts = [], [], {}, Counter()
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            spans.append([{"kind": kind, "start": a, "end": b, "value": v} for a, kind, b, v in found])
            runs = candidates(text)
            others.append([{"start": a, "end": b, "value": v} for a, b, v in runs])
            for a, b, v in runs:  # what is ordinary is learnt from the same runs that are scored, but for those with a base span
                if not any(x < b and a < y for x, _, y, _ in found):
                    name = shape(v)
                    counts[name] += 1
                    ordinary.setdefault(name, set()).add(v)
        # the least of all batches are among the least of each
        least = [{"shape": k, "value": v} for k, vs in ordinary.items() for v in heapq.nsmallest(FIT_VALUES, vs, key=_order)]
        first = lambda rows, kind: pa.array([rows, *[[]] * (len(batch) - 1)][: len(batch)], kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _SPAN_TYPE), pa.array(others, _CANDIDATE_TYPE), first(least, _ORDINARY_TYPE), first([{"shape": k, "n": n} for k, n in counts.items()], _SHAPE_TYPE)],
            names=["doc_id", "spans", "candidates", "ordinary", "shapes"],
        )


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find, FOUND)


def _least(values: DataFrame) -> list[str]:
    """FIT_VALUES distinct values at most, those with the smallest hashes."""
    return [r[0] for r in values.distinct().orderBy(F.xxhash64("value"), "value").limit(FIT_VALUES).collect()]


def _ordinary(found: DataFrame) -> list[str]:
    """FIT_VALUES distinct ordinary runs of each shape at most, those with the smallest hashes: first of each of 256 parts of a shape,
    then of the shape, so that no task holds all runs of a frequent one."""
    runs = found.select(F.explode("ordinary").alias("o")).select("o.shape", "o.value").distinct().withColumn("md5", F.md5("value"))
    part = F.pmod(F.xxhash64("value"), F.lit(256))
    for keys in (["shape", part], ["shape"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("md5", "value"))
        runs = runs.withColumn("place", place).filter(F.col("place") <= FIT_VALUES).drop("place")
    return [r["value"] for r in runs.orderBy("shape", "md5", "value").collect()]  # at most 2^10 shapes


def fit(found: DataFrame) -> Formats:
    """Formats from the labelled values among the found spans, and what is ordinary from the other runs."""
    labelled = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    counts = found.select(F.explode("shapes").alias("s")).groupBy("s.shape").agg(F.sum("s.n").alias("n")).collect()
    return Formats({k: _least(labelled.filter(F.col("kind") == k).select("value")) for k in KINDS[:3]}, _ordinary(found), {r["shape"]: r["n"] for r in counts})


def _remembered(test: Callable[[str], bool]) -> Callable[[str], bool]:
    known: dict[str, bool] = {}

    def answer(value: str) -> bool:
        if value not in known:
            if len(known) > 100_000:
                known.clear()
            known[value] = test(value)
        return known[value]

    return answer


def all_spans(found: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, spans (base ones and added ones, by start and kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, confirmed = _remembered(formats.secret), _remembered(formats.confirmed)
        for batch in batches:
            out = []
            for spans, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                covered = [(s["start"], s["end"]) for s in spans]
                spans = [{**s, "confirmed": confirmed(s["value"])} for s in spans]
                for c in others:
                    near = [s for s in covered if s[0] < c["end"] and c["start"] < s[1]]
                    spans += [{"kind": "format", "start": a, "end": b, "value": c["value"][a - c["start"] : b - c["start"]], "confirmed": True} for a, b in added(c["start"], c["value"], near, secret)]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SCORED_TYPE)], names=["doc_id", "spans"])

    return found.select("doc_id", "spans", "candidates").mapInArrow(run, f"doc_id long, spans array<{_SCORED}>")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and its spans."""
    found = materialize(find(docs, text_col, id_col), "secret-spans")
    return all_spans(found, fit(found))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_confirmed (base spans that held-out formats find)."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base: Column = F.filter("spans", lambda s: s["kind"] != "format")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("format").alias("n_added"), F.size(F.filter("spans", lambda s: (s["kind"] != "format") & s["confirmed"])).cast("long").alias("n_confirmed"))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(MASK)
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of every kind replaced by MASK and n_chars counted anew; no document is dropped."""
    formats = fit(materialize(find(docs), "secret-spans"))
    schema = docs.schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret = _remembered(formats.secret)
        at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
        for batch in batches:
            texts, chars = [], []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    found = base_spans(text)
                    spans = [(a, b) for a, _, b, _ in found]
                    spans += [s for a, b, v in candidates(text) for s in added(a, v, [x for x in spans if x[0] < b and a < x[1]], secret)]
                    text = mask(text, spans) if spans else text
                texts.append(text)
                chars.append(None if text is None else len(text))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if size >= 0:
                columns[size] = pa.array(chars, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
