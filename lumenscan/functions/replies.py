"""Texts of models' replies: cut ends, open fences, wrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of cut words, in order, and how a reply that ends in one goes on.
COMPLETIONS = {
    "prom": "prompt injection attacks.", "inject": "injection attacks.", "attack": "attacks.", "vulnerab": "vulnerabilities.", "secur": "security.", "malicio": "malicious instructions.",
    "unauthor": "unauthorized access.", "sensit": "sensitive data.", "configur": "configuration.", "authent": "authentication.", "permiss": "permissions.", "validat": "validation.",
    "sanitiz": "sanitization.", "prevent": "preventing prompt injection attacks.", "exploit": "exploitation.", "credent": "credentials.", "environm": "environment variables.",
}
CLOSED = tuple(".!?\"')]}")


def polish(text: Column) -> Column:
    """Without outer white space; an odd fence closed; a known cut word at the end completed (white space before it becomes single
    spaces), else a full stop. Null and empty stay as they are."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = strip(text)
    fenced = F.when(F.regexp_count(bare, F.lit("```")) % 2 == 1, F.concat(bare, F.lit("\n```"))).otherwise(bare)
    words = F.split(fenced, r"(?U)\s+")
    last = F.rtrim(F.lower(F.element_at(words, -1)), F.lit(".,!?;:"))
    ending = F.lit(None).cast("string")
    for cut, whole in reversed(COMPLETIONS.items()):
        ending = F.when(F.endswith(last, F.lit(cut)), whole).otherwise(ending)
    completed = F.concat(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.lit(" "), ending)
    ended = F.when(F.right(fenced, F.lit(1)).isin(*CLOSED), fenced).otherwise(F.coalesce(completed, F.concat(fenced, F.lit("."))))
    return F.when(bare == "", text).otherwise(strip(F.replace(F.replace(ended, F.lit(".."), F.lit(".")), F.lit("  "), F.lit(" "))))


def wrap(text: Column, width: int = 100) -> Column:
    """Filled to `width` characters by a fold over words and the white space between them: it is dropped around a break and kept
    within a line and before the first one. Longer words stay whole."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"([\t\n\x0B\f\r ]+|[^\t\n\x0B\f\r ]+)"), 1), lambda p: F.regexp_replace(p, r"[\t\n\x0B\f\r ]", " "))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    flushed = lambda s: F.when(F.rtrim(s["cur"]) != "", F.concat(s["done"], F.array(F.rtrim(s["cur"])))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        blank = F.trim(p) == ""
        fits = F.char_length(s["cur"]) + F.char_length(p) <= width
        return F.when(blank & (s["cur"] == "") & (F.size(s["done"]) > 0), s).when(fits, state(s["done"], F.concat(s["cur"], p))).otherwise(state(flushed(s), F.when(blank, "").otherwise(p)))

    return F.array_join(F.aggregate(parts, state(F.array().cast("array<string>"), F.lit("")), step, flushed), "\n")
