"""Conditions whose value can be told from the text alone, evaluated by folds over their tokens; nothing is run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pat

# Words of a condition that are no variables.
KEYWORDS = ("in", "not", "and", "or", "is", "True", "False", "None", "if", "else", "elif")
ARITHMETIC = r"^[\d\s\+\-\*\/\%\>\<\=\!\(\)]+$"
QUOTED_IN = r"""^['"](\w+)['"]\s+(?:not\s+)?in\s+['"](.+?)['"]$"""
NEGATED = r"^not\s+(\w+)$"
NUMBER_CONSTANT = r"^([a-zA-Z_]\w*)\s*=\s*(\d+\.?\d*)\s*$"
TEXT_CONSTANT = r"""^([a-zA-Z_]\w*)\s*=\s*['"](.+?)['"]"""
EMPTY_CONSTANT = r"""^(\w+)\s*=\s*['"]['"]"""

_TOKEN = r"(\d+|//|\*\*|<<|>>|<=|>=|==|!=|[-+*/%<>()=!])"
_RANK = {"<": 1, ">": 1, "<=": 1, ">=": 1, "==": 1, "!=": 1, "+": 2, "-": 2, "*": 3, "/": 3, "%": 3, "//": 3, "neg": 4, "pos": 4}
_STATE = "struct<vals:array<struct<v:double,last:double,cmp:boolean>>,ops:array<string>,need:boolean,ok:boolean>"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(op: Column) -> Column:
    ranks = F.lit(0)
    for rank in (1, 2, 3, 4):
        ranks = F.when(op.isin([k for k, v in _RANK.items() if v == rank]), rank).otherwise(ranks)
    return ranks


def _value(v: Column, last: Column | None = None, cmp: bool = False) -> Column:
    return F.struct(v.cast("double").alias("v"), (v if last is None else last).cast("double").alias("last"), F.lit(cmp).alias("cmp"))


def _state(vals: Column, ops: Column, need: Column, ok: Column) -> Column:
    return F.struct(vals.alias("vals"), ops.alias("ops"), need.alias("need"), ok.alias("ok"))


def _drop(items: Column, n: int) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - n, F.lit(0)))


def _reduce(s: Column) -> Column:
    """Applies the operator on top to the values on top. A comparison keeps its right side, so that a < b < c compares b and c."""
    op, b, a = F.try_element_at(s["ops"], F.lit(-1)), F.try_element_at(s["vals"], F.lit(-1)), F.try_element_at(s["vals"], F.lit(-2))
    x, y = a["v"], b["v"]
    left = F.when(a["cmp"], a["last"]).otherwise(x)
    test = F.when(op == "<", left < y).when(op == ">", left > y).when(op == "<=", left <= y).when(op == ">=", left >= y).when(op == "==", left == y).otherwise(left != y)
    number = F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(y == 0, None).when(op == "/", x / y).when(op == "//", F.floor(x / y)).otherwise(x - F.floor(x / y) * y)
    known = F.when(a["cmp"] & (x == 0), F.lit(False)).when(x.isNotNull(), test)  # after a false comparison the rest is not looked at
    out = F.when(_rank(op) == 1, _value(known.cast("int"), y, True)).otherwise(_value(number))
    unary = _value(F.when(op == "neg", -y).otherwise(y))
    one = F.when(_rank(op) == 4, F.concat(_drop(s["vals"], 1), F.array(unary))).otherwise(F.concat(_drop(s["vals"], 2), F.array(out)))
    return _state(one, _drop(s["ops"], 1), s["need"], s["ok"])


def _settle(s: Column, rank: Column) -> Column:
    """Applies operators from the top while they bind at least as tightly as `rank`; a parenthesis stops it."""
    top = lambda t: F.try_element_at(t["ops"], F.lit(-1))
    once = lambda t, _: F.when(t["ok"] & (F.size(t["ops"]) > 0) & (top(t) != "(") & (_rank(top(t)) >= rank), _reduce(t)).otherwise(t)
    return F.aggregate(F.array_repeat(F.lit(0), F.size(s["ops"])), s, once)


def arithmetic(text: Column) -> Column:
    """Truth of an expression of integers, + - * / // %, comparisons (chains too) and parentheses; null if it is none, if it
    divides by zero on the way or if it holds powers or shifts."""
    no = F.lit(False)

    def step(s: Column, t: Column) -> Column:
        failed = _state(s["vals"], s["ops"], s["need"], no)
        number = _state(F.concat(s["vals"], F.array(_value(t.try_cast("double")))), s["ops"], no, ~t.rlike("^0+[1-9]"))
        push = lambda st, op: _state(st["vals"], F.concat(st["ops"], F.array(op)), F.lit(True), st["ok"])

        def close(st: Column) -> Column:
            inner = F.try_element_at(st["vals"], F.lit(-1))["v"]
            return _state(F.concat(_drop(st["vals"], 1), F.array(_value(inner))), _drop(st["ops"], 1), no, st["ok"] & (F.size(st["ops"]) > 0))

        unary = F.when(t == "-", F.lit("neg")).otherwise(F.lit("pos"))
        operand = F.when(t.rlike("^[0-9]"), number).when(t == "(", push(s, t)).when(t.isin("-", "+"), push(s, unary)).otherwise(failed)
        operator = F.when(t == ")", let(_settle(s, F.lit(1)), close)).when(_rank(t) > 0, let(_settle(s, _rank(t)), lambda st: push(st, t))).otherwise(failed)
        return F.when(~s["ok"], s).when(s["need"], operand).otherwise(operator)

    start = F.from_json(F.lit('{"vals": [], "ops": [], "need": true, "ok": true}'), _STATE)
    parsed = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), 1), start, step)
    return let(let(parsed, lambda s: _settle(s, F.lit(1))), lambda s: F.when(s["ok"] & ~s["need"] & (F.size(s["ops"]) == 0) & (F.size(s["vals"]) == 1), F.get(s["vals"], F.lit(0))["v"] != 0))


def constants(lines: Column) -> Column:
    """(n, name, value) of lines (structs with n and the stripped text s) that assign a number or a quoted text to a name."""

    def one(x: Column) -> Column:
        number, text = x["s"].rlike(pat(NUMBER_CONSTANT)), x["s"].rlike(pat(TEXT_CONSTANT))
        at = lambda p, g: F.regexp_extract(x["s"], pat(p), g)
        found = lambda p, v: F.struct(x["n"].alias("n"), at(p, 1).alias("name"), v.alias("value"))
        return F.when(number, found(NUMBER_CONSTANT, at(NUMBER_CONSTANT, 2))).when(text, found(TEXT_CONSTANT, F.concat(F.lit('"'), at(TEXT_CONSTANT, 2), F.lit('"'))))

    return F.array_compact(F.transform(lines, one))


def resolve(condition: Column, known: Column, before: Column) -> Column:
    """Names replaced by the last constant that a line before `before` gives them."""

    def one(piece: Column) -> Column:
        last = F.try_element_at(F.filter(known, lambda c: (c["n"] < before) & (c["name"] == piece)), F.lit(-1))
        return F.when(piece.rlike("^[A-Za-z_]") & ~piece.isin(*KEYWORDS), F.coalesce(last["value"], piece)).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(condition, F.lit(pat(r"(\w+|\W)")), 1), one), "")


def static_truth(resolved: Column, empty_before: Column) -> Column:
    """Truth of a resolved condition, null if it cannot be told. empty_before: names that an earlier line makes ''."""
    held = F.contains(F.regexp_extract(resolved, pat(QUOTED_IN), 2), F.regexp_extract(resolved, pat(QUOTED_IN), 1))
    return (
        F.when(resolved.rlike(pat(ARITHMETIC)), arithmetic(resolved))
        .when(resolved.rlike(pat(QUOTED_IN)), held != F.contains(resolved, F.lit("not ")))
        .when(resolved.rlike(pat(NEGATED)) & F.array_contains(empty_before, F.regexp_extract(resolved, pat(NEGATED), 1)), F.lit(True))
    )
