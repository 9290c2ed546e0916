"""Token counts by overlap resynchronisation.

The pre-tokenizer of a byte-level BPE vocabulary starts a new piece at every space that follows a character
which is not white space: no alternative of its pattern holds white space behind its first character except runs of
white space, and such a run cannot begin before that space. What comes before that position never changes what comes
after it. So these positions are proven boundaries: pieces between them can be encoded alone, by the library, and a
piece met before is not encoded again.

Texts over `chunk_chars` are encoded by the library in chunks that overlap, with the offsets of their tokens. Two neighbours are
spliced at a proven boundary of the overlap at which both have a token's border and from which on, to the next such boundary, both
give the same ids: what stands before it comes from the left chunk, what stands behind it from the right one. Where the overlap holds
no such place (a span without spaces), it is doubled and encoded again until it does or the text ends.

Vocabularies of another kind are given whole texts; nothing is proven about them.

Defined cases: null counts as empty (0 tokens); repeated rows give repeated results; an empty table an empty result;
a null doc_id is kept; other columns are not touched. Special strings inside texts are treated as the library does by
default.
"""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
#: Pieces that a worker remembers at most; further ones are encoded again for each batch.
REMEMBERED = 600_000
#: Pieces in a call of the library.
CALL_PIECES = 2048
#: ASCII letters and then marks (without the apostrophe of contractions): the byte-level pattern makes at most two pre-tokens of them.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"( ?)([A-Za-z]+)({_MARKS})").fullmatch
#: A space that follows white space or begins the text: there not every space is a boundary.
_INSIDE = re.compile(r"(?:\s|\A) ").search


class Encoded:
    """The ids of a span of a text and where, in the text, their tokens begin and end."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        e = tokenizer.encode(text[begin:end], add_special_tokens=False)
        self.ids = e.ids
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + begin
        # a post-processor may take white space off the offsets, never more
        self.start, self.end = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])

    def token_at(self, place: int) -> int | None:
        """The first token behind a place, if no token reaches over it."""
        k = int(np.searchsorted(self.end, place, "right"))
        return k if k == len(self.ids) or self.start[k] >= place else None


class PieceEncoder:
    """Encodes texts to a list of values, one per piece; `value` maps the ids of a piece to what is kept."""

    def __init__(self, tokenizer_path: str, value: Callable[[list[int]], object]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.value = value
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._proven(spec)
        # no added token may lie within a plain piece
        self.plain = self.by_piece and not any(re.fullmatch(f" ?[A-Za-z]*{_MARKS}", t["content"]) for t in spec.get("added_tokens") or [])
        self.words: dict[str, object] = {}
        self.after_space: dict[str, object] = {}
        self.at_start: dict[str, object] = {}
        #: How often an overlap was doubled.
        self.widened = 0

    @staticmethod
    def _proven(spec: dict) -> bool:
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        return (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )

    def _whole(self, texts: list[str]) -> list[object]:
        value = self.value
        return [value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[object]:
        """Each piece encoded alone. Plain ones go to the library's model by pre-token; for the others one call takes many
        as a pre-split text and names the piece of every id."""
        if not self.by_piece:
            return self._whole(pieces)
        value, out, rest = self.value, [None] * len(pieces), []
        for k, piece in enumerate(pieces):
            m = _PLAIN(piece) if self.plain else None
            if m is None:
                rest.append(k)
            else:
                space, word, tail = m.groups()
                own = self._word("\u0120" + word if space else word)
                out[k] = own + self._word(tail) if tail else own
        for at in range(0, len(rest), CALL_PIECES):
            places = rest[at : at + CALL_PIECES]
            e = self.tokenizer.encode([pieces[k] for k in places], is_pretokenized=True, add_special_tokens=False)
            ids = e.ids
            ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(places))).tolist()
            for k, i, j in zip(places, [0, *ends], ends):
                out[k] = value(ids[i:j])
        return out

    def _word(self, word: str) -> object:
        """A pre-token in the vocabulary's byte alphabet: printable ASCII stands for itself, U+0120 for a space."""
        v = self.words.get(word)
        if v is None:
            v = self.value([t.id for t in self.tokenizer.model.tokenize(word)])
            if len(self.words) < REMEMBERED and len(word) <= 64:
                self.words[word] = v
        return v

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts between proven boundaries; every part but the first stands after one space."""
        parts = text.split(" ")
        if not _INSIDE(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if out[-1] and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def batch(self, texts: list[str]) -> list[list[object]]:
        """The values of each text's pieces, in order."""
        if not self.by_piece:
            return [[v] for v in self._encode(texts)]
        known, get = self.after_space, self.after_space.get
        split, missing, starts = [], set(), set()
        for text in texts:
            head, *rest = text.split(" ")
            values = [*map(get, rest)]
            gaps = [k for k, v in enumerate(values) if v is None] if None in values else ()
            # parts that are empty or end in white space are never remembered, so the gaps show whether there are any
            if not head or head[-1].isspace() or any(not rest[k] or rest[k][-1].isspace() for k in gaps):
                head, *rest = self.pieces(text)
                values = [*map(get, rest)]
                gaps = [k for k, v in enumerate(values) if v is None]
            missing.update([rest[k] for k in gaps])
            starts.add(head)
            split.append((head, rest, values, gaps))
        order = list(missing)
        local = dict(zip(order, self._encode([" " + p for p in order])))
        if len(known) < REMEMBERED:
            known.update((k, v) for k, v in local.items() if k and len(k) <= 64 and not k[-1].isspace())
        order = list(starts - self.at_start.keys())
        first = dict(zip(order, self._encode(order)))
        if len(self.at_start) < REMEMBERED // 8:
            self.at_start.update((k, v) for k, v in first.items() if len(k) <= 64)
        out = []
        for head, rest, values, gaps in split:
            for k in gaps:
                values[k] = local[rest[k]]
            out.append([first[head] if head in first else self.at_start[head], *values])
        return out

    def long(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[object]]:
        """The values of a huge text, a chunk at a time, spliced where both neighbours agree."""
        n, overlap = len(text), max(1, min(overlap, chunk - 1))
        begin, end, used = 0, min(n, chunk + overlap), 0
        left = Encoded(self.tokenizer, text, begin, end)
        while end < n:
            middle, wide = end - overlap, overlap
            while True:
                stop = min(n, middle + chunk + wide)
                right = Encoded(self.tokenizer, text, middle, stop)
                splice = self._splice(left, right, self._boundaries(text, middle, end))
                if splice:
                    break
                self.widened += 1
                wide *= 2
                end = min(n, middle + wide)
                left = Encoded(self.tokenizer, text, begin, end)
                if end == n:
                    break
            if not splice:
                break
            yield [self.value(left.ids[used : splice[0]])]
            left, begin, end, used = right, middle, stop, splice[1]
        yield [self.value(left.ids[used:])]

    @staticmethod
    def _splice(left: Encoded, right: Encoded, boundaries: list[int]) -> tuple[int, int] | None:
        """The tokens of both at the first boundary from which they agree up to the next one."""
        places = [(left.token_at(b), right.token_at(b)) for b in boundaries]
        for (i, j), (i2, j2) in zip(places, places[1:]):
            if None not in (i, j, i2, j2) and left.ids[i:i2] == right.ids[j:j2]:
                return i, j
        return None

    @staticmethod
    def _boundaries(text: str, begin: int, end: int) -> list[int]:
        at, out = text.find(" ", begin + 1, end), []
        while at >= 0:
            if not text[at - 1].isspace():
                out.append(at)
            at = text.find(" ", at + 1, end)
        return out

    def all(self, texts: list[str | None], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[Iterator[list[object]]]:
        """For each text its values in one or more lists; neighbouring short texts share the library calls."""
        short: list[str] = []
        size = 0

        def flush():
            for values in self.batch(short):
                yield iter([values])
            short.clear()

        for text in texts:
            text = text or ""
            if self.by_piece and len(text) > chunk:
                yield from flush()
                size = 0
                yield self.long(text, chunk, overlap)
            else:
                short.append(text)
                size += len(text)
                if size > 1 << 20:
                    yield from flush()
                    size = 0
        yield from flush()


_encoders: dict[tuple, object] = {}


def encoder(path: str, kind: str):
    """One per worker process and vocabulary."""
    if (path, kind) not in _encoders:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path, kind] = model
        else:
            _encoders[path, kind] = PieceEncoder(path, len if kind == "count" else _pack)
    return _encoders[path, kind]


def _pack(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def count_texts(texts: list[str | None], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    e = encoder(path, "count")
    if not isinstance(e, PieceEncoder):
        return [len(x) for x in e.encode([t or "" for t in texts], num_threads=1)]
    return [sum(map(sum, parts)) for parts in e.all(texts, chunk, overlap)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text_col: str = "text", id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. A narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count_texts(batch.column(1).to_pylist(), tokenizer_path, chunk_chars, overlap_chars), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
