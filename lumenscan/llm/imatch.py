"""I-Match fingerprints, by DataFrame expressions alone.

Terms are runs of letters, digits and non-ASCII characters, ASCII letters in lower case. The lexicon holds the terms in
a band of inverse document frequency: found in at least one document of 1024 and at most one of two. Randomised subsets
of it are drawn by a hash of the term: 16 disjoint parts, each thinned to 2^-level of its terms. A text's fingerprint has,
for each part and three levels that suit its number of terms, the hash of its sorted distinct terms in that subset (none:
empty); a slot survives an edit exactly if none of its few terms came or went, so the share of equal slots grades likeness.

The lexicon's size is bounded by 1024 times the mean number of distinct terms of a document, whatever the number of
documents; it is sent to the tasks if it holds at most MAX_SENT terms, else joined by shuffle. Only the terms that a
fingerprint draws, some dozens a text, are looked up. Texts are shuffled once: each meets there its own place in the order and
the number of code points that the document before it wants; only those go on.

Defined cases: a null text is empty; a null doc_id comes first in the order, rows of one doc_id by a hash of their texts.
Repeated rows (same doc_id and text) take one place in the order and give repeated results; a single document is its own
next one. Where no drawn term lies in the band, all drawn terms count; texts without terms have the same, empty
fingerprint. Equal fingerprints have likeness 1; fingerprints without a level or a filled slot in common have likeness 0. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The band, as shares of the documents that hold a term: at least 1 of RARE, at most 1 of COMMON.
RARE, COMMON = 1024, 2
PARTS, LEVELS = 16, 3
#: A text of 2^k terms or more starts at level k - SPARE, where a part holds 2 to 4 of its terms.
SPARE = 5
#: Of a term's MD5, the first digit names the part, the next seven are its draw.
DRAW = 1 << 28
MAX_SENT = 500_000
_KEY = ["is_null", "id", "mark"]


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""))


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON, text_col: str = "text") -> DataFrame:
    """The terms of the band."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.filter((F.col("df") * rare >= n) & (F.col("df") * common <= n)).select("term")


def _draw(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 2, 7), 16, 10).cast("int")


def _limit(level: Column) -> Column:
    return F.floor(F.lit(DRAW) / F.pow(F.lit(2.0), level)).cast("int")


def _level(n_terms: Column) -> Column:
    return F.greatest(F.length(F.bin(n_terms)) - (SPARE + 1), F.lit(0))


def _drawn(found: Column, level: Column, edited: bool) -> Column:
    mine = F.filter(found, lambda t: _draw(t) < _limit(level))
    return F.transform(mine, lambda t: F.struct(F.lit(edited).alias("edited"), F.conv(F.substring(F.md5(t), 1, 1), 16, 10).cast("int").alias("part"), _draw(t).alias("draw"), t.alias("term")))


def _slots(drawn: Column, level: Column) -> Column:
    """PARTS * LEVELS hashes from the looked-up terms, parts first; empty where a subset holds no term."""
    in_band = F.filter(drawn, lambda x: x["in_band"])
    use = F.when(F.size(in_band) > 0, in_band).otherwise(drawn)
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.filter(use, lambda x: x["part"] == p))

    def digest(part: Column, k: int) -> Column:
        subset = F.transform(F.filter(part, lambda x: x["draw"] < _limit(level + k)), lambda x: x["term"])
        return F.when(F.size(subset) > 0, F.left(F.md5(F.array_join(F.sort_array(subset), " ")), F.lit(8))).otherwise("")

    return F.flatten(F.transform(parts, lambda part: F.array(*(digest(part, k) for k in range(LEVELS)))))


def likeness(level_a: Column, a: Column, level_b: Column, b: Column) -> Column:
    """Equal slots among those filled on either side, over the levels that both fingerprints have."""
    shift = level_a - level_b  # level k of a is level k + shift of b
    at = F.filter(F.sequence(F.lit(0), F.lit(PARTS * LEVELS - 1)), lambda j: (j % LEVELS + shift).between(0, LEVELS - 1))
    pairs = F.transform(at, lambda j: F.struct(F.get(a, j).alias("x"), F.get(b, j + shift).alias("y")))
    filled = F.filter(pairs, lambda s: (s["x"] != "") | (s["y"] != ""))
    same = F.size(F.filter(filled, lambda s: s["x"] == s["y"]))
    return F.when((shift == 0) & (a == b), 1.0).when(F.size(filled) > 0, same / F.size(filled)).otherwise(0.0).cast("double")


def _fingerprint(level: Column, slots: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), F.array_join(slots, ","))


def _keyed(docs: DataFrame) -> DataFrame:
    """A key that joins null ids too; and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("is_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _places(rows: DataFrame) -> DataFrame:
    """Per key: how often it occurs, the key before it in the order, and the code points that one takes over. Keys only, no
    texts: sorted by ranges, numbered within them, and each range moved by the sizes of those before it."""
    counted = rows.groupBy(*_KEY, F.char_length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.desc("is_null"), F.asc("id"), F.asc("mark"), F.asc("n")]
    number = F.monotonically_increasing_id()
    ranged = materialize(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", number), "order")
    ranged = ranged.select(*_KEY, "n", "copies", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # a row a range
    moved = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = ranged.count()
    ranked = ranged.join(F.broadcast(moved), "range").select(*_KEY, "n", "copies", (F.col("before") + F.col("at")).alias("rank"))
    previous = ranked.select(((F.col("rank") + 1) % max(total, 1)).alias("rank"), *(F.col(c).alias(f"{c}_p") for c in _KEY), F.floor(F.col("n") / 4).cast("int").alias("wanted"))
    return ranked.join(previous, "rank").select(*_KEY, "copies", *(f"{c}_p" for c in _KEY), "wanted")


def with_edits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per key: its text and the edited text; and the places."""
    rows = _keyed(docs)
    places = materialize(_places(rows), "places")
    if not places.filter("copies > 1").isEmpty():  # repeated rows: one of them is enough
        rows = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    placed = rows.join(places, _KEY)
    heads = placed.select(*(F.col(f"{c}_p").alias(c) for c in _KEY), F.left(F.col("text"), F.col("wanted")).alias("head"))
    n = F.char_length("text")
    kept = n - F.floor(n / 4).cast("int")
    whole = placed.join(heads, _KEY)
    return whole.select(*_KEY, *(f"{c}_p" for c in _KEY), "copies", n.alias("n_chars"), "text", F.concat(F.left(F.col("text"), kept), F.col("head")).alias("edited")), places


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: fingerprints of its text and its edited text, and how like they and the next document's are."""
    words = materialize(lexicon(docs), "lexicon")
    texts, places = with_edits(docs)
    found = texts.select(*_KEY, *(f"{c}_p" for c in _KEY), "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
    meta = [*_KEY, *(f"{c}_p" for c in _KEY), "copies", "n_chars", "edited_sha256", "level_a", "level_b"]
    found = found.withColumns({"level_a": _level(F.size("a")), "level_b": _level(F.size("b"))})
    drawn = found.select(*meta, F.explode_outer(F.concat(_drawn(F.col("a"), F.col("level_a"), False), _drawn(F.col("b"), F.col("level_b"), True))).alias("x"))
    drawn = drawn.select(*meta, "x.*")
    band = words.withColumn("in_band", F.lit(True))
    known = drawn.join(F.broadcast(band) if words.count() <= MAX_SENT else band, "term", "left")
    of_text = known.groupBy(*meta).agg(F.collect_set(F.when(F.col("term").isNotNull(), F.struct("edited", "part", "draw", "term", F.coalesce("in_band", F.lit(False)).alias("in_band")))).alias("drawn"))
    prints = of_text.select(
        *meta,
        _slots(F.filter("drawn", lambda x: ~x["edited"]), F.col("level_a")).alias("a"),
        _slots(F.filter("drawn", lambda x: x["edited"]), F.col("level_b")).alias("b"),
    )
    prints = materialize(prints, "prints")
    discard(words)
    discard(places)
    following = prints.select(*(F.col(f"{c}_p").alias(c) for c in _KEY), F.col("level_a").alias("level_n"), F.col("a").alias("next"))
    each = prints.join(following, _KEY)
    # a repeated row as often as it occurs, in steps that bound the array
    times = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 100_000)))).withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.lit(100_000), F.col("copies") - F.col("block") * 100_000).cast("int"))))
    return times.select(
        F.when(~F.col("is_null"), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        _fingerprint(F.col("level_a"), F.col("a")).alias("fingerprint"), _fingerprint(F.col("level_b"), F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("level_a"), F.col("a"), F.col("level_b"), F.col("b")).alias("near_edited"),
        likeness(F.col("level_a"), F.col("a"), F.col("level_n"), F.col("next")).alias("near_next"),
    )
