"""General flow: user input followed through configurations, maps, lists, branches and overwrites, to sinks of ten categories.

A file is one row. Its lines become a short program of gen and kill facts (structs, from patterns alone); branches whose
condition can be told from the text take part with their active side only. The program is folded four times over a state
of tainted names, tainted keys and lists, and what is tainted at the end is looked up around each sink. Equal texts are
followed once; those without a source or a sink leave before they are split into lines, and no line is shuffled.

Quirks that results depend on are kept: names that take user input directly are never cleared outside of `match`; a
literal clears a name only at the depth of the last `if` or above; the fold carries its state into the next sweep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import EMPTY_CONSTANT, constants, let, resolve, static_truth
from ..functions.text import pat
from .copies import digest, for_all, once
from .injection import LANGUAGES
from .scoped import words

SWEEPS = 4


@dataclass(frozen=True)
class Flow:
    category: str
    vulnerability_type: str
    cwe_id: str
    severity: str
    patterns: tuple[str, ...]
    safe: tuple[str, ...] = ()


# Categories in order, their sinks and what makes a sink safe.
FLOWS = (
    Flow("sqli", "SQL Injection", "CWE-89", "CRITICAL", (r"\.execute\s*\(\s*\w+\s*\)", r"\.execute\s*\(\s*f['\"]"), (r"\.execute\s*\([^,]+,\s*[\(\[]",)),
    Flow("cmdi", "Command Injection", "CWE-78", "CRITICAL", (r"subprocess\.(?:run|call|Popen|check_output)\s*\(", r"os\.system\s*\(", r"os\.popen\s*\(")),
    Flow("codeinj", "Code Execution", "CWE-94", "CRITICAL", (r"(?<!\w)eval\s*\(", r"(?<!\w)exec\s*\(")),
    Flow("pathtraver", "Path Traversal", "CWE-22", "HIGH", (r"codecs\.open\s*\(", r"(?<!\w)open\s*\(", r"send_file\s*\(", r"send_from_directory\s*\(")),
    Flow("xss", "XSS", "CWE-79", "HIGH", (r"RESPONSE\s*\+=",), (r"escape_for_html\s*\(\s*(\w+)\s*\)",)),
    Flow("redirect", "Open Redirect", "CWE-601", "HIGH", (r"redirect\s*\(",)),
    Flow("xpathi", "XPath Injection", "CWE-643", "CRITICAL", (r"(?:lxml\.etree\.XPath|etree\.XPath|elementpath\.select|\.xpath)\s*\(",), (r"\.replace\s*\(\s*['\"](?:\\?'|&apos;)['\"]",)),
    Flow("ldapi", "LDAP Injection", "CWE-90", "CRITICAL", (r"conn\.search\s*\(",)),
    Flow("trustbound", "Trust Boundary Violation", "CWE-501", "HIGH", (r"flask\.session\s*\[", r"(?<!\w)session\s*\[")),
    Flow("deserialization", "Unsafe Deserialization", "CWE-502", "CRITICAL", (r"pickle\.loads?\s*\(", r"(?<!\w)yaml\.load\s*\(", r"yaml\.unsafe_load\s*\(", r"marshal\.loads?\s*\(", r"jsonpickle\.decode\s*\("), (r"yaml\.safe_load",)),
)
# Sources and the forms of lines that pass taint on.
INPUT = r"(\w+)\s*=\s*(?:urllib\.parse\.unquote_plus\s*\(\s*request\.|request\.(?:form|args|cookies|json|headers|data)(?:\.get(?:list)?\s*\(|\.get\s*\(|\[)|input\s*\(|request\.path\.split|helpers\.separate_request\.request_wrapper)"
WRAPPED = r"(\w+)\s*=\s*helpers\.separate_request\.request_wrapper\s*\("
ELEMENT = r"(\w+)\s*=\s*(\w+)\s*\[\s*\d+\s*\]"
CONF_SET = r"""(\w+)\.set\s*\(\s*['"](\w+)['"],\s*['"]([^'"]+)['"],\s*(\w+)\s*\)"""
CONF_GET = r"""(\w+)\s*=\s*(\w+)\.get\s*\(\s*['"](\w+)['"],\s*['"]([^'"]+)['"]\s*\)"""
KEY_SET = r"""(\w+)\s*\[\s*['"]([^'"]+)['"]\s*\]\s*=\s*(\w+)"""
KEY_GET = r"""(\w+)\s*=\s*(\w+)\s*\[\s*['"]([^'"]+)['"]\s*\]"""
INDEX_GET = r"^\s*(\w+)\s*=\s*(\w+)\s*\[\s*(\d+)\s*\]"
LIST_NEW = r"^\s*(\w+)\s*=\s*\[\s*\]"
APPEND_NAME = r"(\w+)\.append\s*\(\s*(\w+)\s*\)"
APPEND_TEXT = r"""(\w+)\.append\s*\(\s*['"]"""
POP = r"(\w+)\.pop\s*\(\s*(\d+)\s*\)"
ASSIGNED = r"^\s*(\w+)\s*=\s*(.*)"
CALLED = r"^\w+\.\w+\s*\("
LITERAL = r"""^(?:['"].*['"]|\d+\.?\d*)$"""
SAFE_CALL = r"^(?:str|int|float|bool|len)\s*\("
BRANCH = r"^(?:if |if\t|elif |else:)"
IF = r"^if\s+(.+):"
MATCH = r"^match\s+(\w+)\s*:"
CASE = r"^case\s+(.+?):"
TERNARY = r"^\s*(\w+)\s*=\s*(.+?)\s+if\s+(.+?)\s+else\s+(.+)"
IF_LINES, MATCH_LINES = 29, 49
SQL_TEXT = r"(\w+)\s*=\s*f['\"]"
SQL_INLINE = r"\.execute\s*\(\s*f['\"]"
SQL_BACK = 8
REGION_BEFORE, REGION_AFTER = 5, 3

_OP = "n int, seq int, kind string, lhs string, name string, key string, at int, words array<string>, level int"
_OPS = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _OP.split(', '))}>>"


def _op(n: Column, seq: int | Column, kind: str | Column, lhs: Column | None = None, name: Column | None = None, key: Column | None = None, at: Column | None = None, held: Column | None = None, level: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    none, text = F.lit(None), F.lit("")
    return F.struct(
        n.cast("int").alias("n"), lit(seq).cast("int").alias("seq"), lit(kind).alias("kind"), (text if lhs is None else lhs).alias("lhs"), (text if name is None else name).alias("name"), (text if key is None else key).alias("key"),
        (none if at is None else at).cast("int").alias("at"), (F.array().cast("array<string>") if held is None else held).alias("words"), (none if level is None else level).cast("int").alias("level"),
    )


def _width(line: Column) -> Column:
    """Columns of the indentation, tabs to the next fourth."""
    return F.aggregate(F.split(F.regexp_extract(line, pat(r"^(\s*)"), 1), ""), F.lit(0), lambda w, c: F.when(c == "\t", F.floor(w / 4).cast("int") * 4 + 4).when(c == "", w).otherwise(w + 1))


def numbered(code: Column) -> Column:
    """n, line, stripped line, indentation in characters and in columns."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.transform(F.split(code, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"), strip(x).alias("s"), F.length(F.regexp_extract(x, pat(r"^(\s*)"), 1)).alias("indent"), _width(x).alias("width")))


def _is_code(x: Column) -> Column:
    return (x["s"] != "") & ~x["s"].startswith("#")


def _group(x: Column, pattern: str, g: int) -> Column:
    return F.regexp_extract(x["line"], pat(pattern), g)


def sources(lines: Column) -> Column:
    """Names that take user input, and those that take an element of one above."""

    def step(held: Column, x: Column) -> Column:
        direct = F.array_compact(F.array(*(F.when(x["line"].rlike(pat(p)), _group(x, p, 1)) for p in (INPUT, WRAPPED))))
        return let(F.array_union(held, direct), lambda h: F.when(x["line"].rlike(pat(ELEMENT)) & F.array_contains(h, _group(x, ELEMENT, 2)), F.array_union(h, F.array(_group(x, ELEMENT, 1)))).otherwise(h))

    return F.aggregate(F.filter(lines, lambda x: x["line"].rlike(pat(f"{INPUT}|{ELEMENT}"))), F.array().cast("array<string>"), step)


def _assignment(x: Column) -> Column:
    """lhs and words of the right side."""
    return F.struct(x["n"].alias("n"), _group(x, ASSIGNED, 1).alias("lhs"), words(_group(x, ASSIGNED, 2)).alias("words"))


_BLOCK = "struct<mode:string,stop:boolean,handled:array<int>,taken:array<struct<n:int,lhs:string,words:array<string>>>>"


def _block(lines: Column, head: Column, most: int, choose) -> Column:
    """Lines after the head that belong to it, and the assignments of its active side. `choose(state, line)` gives the next
    mode (active, idle or the like) of a line that opens a side, null for others; `stop` ends the block."""

    def step(st: Column, x: Column) -> Column:
        opened, ends = choose(st, x)
        keep = lambda mode, stop, handled, taken: F.struct(mode.alias("mode"), stop.alias("stop"), handled.alias("handled"), taken.alias("taken"))
        more = F.concat(st["handled"], F.array(x["n"]))
        body = F.when((st["mode"] == "active") & x["line"].rlike(pat(ASSIGNED)), F.concat(st["taken"], F.array(_assignment(x)))).otherwise(st["taken"])
        return (
            F.when(st["stop"] | (x["s"] == ""), st)
            .when(opened.isNotNull(), keep(opened, F.lit(False), more, st["taken"]))
            .when(ends, keep(st["mode"], F.lit(True), st["handled"], st["taken"]))
            .otherwise(keep(st["mode"], F.lit(False), more, body))
        )

    start = lambda mode: F.from_json(F.concat(F.lit('{"mode": "'), mode, F.lit('", "stop": false, "handled": [], "taken": []}')), _BLOCK)
    first = F.when(head["truth"], "active").otherwise("idle")
    return F.aggregate(F.slice(lines, head["n"] + 1, F.lit(most)), start(first), step)


def _heads(lines: Column, known: Column, empty: Column) -> Column:
    """`if` and `match` lines that can be told: n, width, truth (of the condition), guess (value matched)."""
    elements = F.filter(lines, lambda x: x["line"].rlike(pat(INDEX_GET)))
    texts = F.filter(lines, lambda x: x["line"].rlike(pat(r"""^\s*(\w+)\s*=\s*['"](.+?)['"]""")))
    text_of = lambda x: _group(x, r"""^\s*(\w+)\s*=\s*['"](.+?)['"]""", 2)
    name_of = lambda x: _group(x, r"^\s*(\w+)\s*=", 1)
    last = lambda rows, n, name: F.try_element_at(F.filter(rows, lambda y: (y["n"] < n) & (name_of(y) == name)), F.lit(-1))

    def guess(x: Column) -> Column:
        name = F.regexp_extract(x["s"], pat(MATCH), 1)
        element, text = last(elements, x["n"], name), last(texts, x["n"], name)

        def letter(e: Column) -> Column:
            whole = text_of(last(texts, x["n"], _group(e, INDEX_GET, 2)))
            at = _group(e, INDEX_GET, 3).try_cast("int")
            return F.when(at < F.length(whole), F.substring(whole, at + 1, 1))

        return F.when(text.isNull() | (element["n"] > text["n"]), let(element, letter)).otherwise(text_of(text))

    def one(x: Column) -> Column:
        is_if = x["s"].rlike(pat(IF))
        emptied = F.transform(F.filter(empty, lambda e: e["n"] < x["n"]), lambda e: F.regexp_extract(e["s"], pat(EMPTY_CONSTANT), 1))
        truth = F.when(is_if, let(resolve(F.btrim(F.regexp_extract(x["s"], pat(IF), 1)), known, x["n"]), lambda c: static_truth(c, emptied)))
        return F.struct(x["n"].alias("n"), x["width"].alias("width"), is_if.alias("is_if"), truth.alias("truth"), F.when(~is_if, guess(x)).alias("guess"))

    found = F.transform(F.filter(lines, lambda x: x["s"].rlike(pat(f"{IF}|{MATCH}"))), one)
    return F.filter(found, lambda h: h["truth"].isNotNull() | h["guess"].isNotNull())


def _blocks(lines: Column, heads: Column) -> Column:
    def one(h: Column) -> Column:
        def of_if(st: Column, x: Column):
            level = x["width"] == h["width"]
            opened = F.when(level & x["s"].startswith("else:"), F.when(h["truth"], "idle").otherwise("active"))
            return opened, (level & x["s"].startswith("elif ")) | ((x["width"] <= h["width"]) & ~x["s"].startswith("#"))

        def of_match(st: Column, x: Column):
            value = F.btrim(F.regexp_extract(x["s"], pat(CASE), 1))
            bare = F.transform(F.split(value, r"\|"), lambda v: F.regexp_replace(F.btrim(v), """^['"]+|['"]+$""", ""))
            opened = F.when(x["s"].rlike(pat(CASE)), F.when((value == "_") | F.array_contains(bare, h["guess"]), "active").otherwise("idle"))
            return opened, ~x["s"].startswith("case ") & (x["width"] <= h["width"]) & ~x["s"].startswith("#")

        block = F.when(h["is_if"], _block(lines, h, IF_LINES, of_if)).otherwise(_block(lines, h, MATCH_LINES, of_match))
        return let(block, lambda b: F.struct(h["n"].alias("n"), h["is_if"].alias("is_if"), b["handled"].alias("handled"), b["taken"].alias("taken")))

    return F.transform(heads, one)


def _active(blocks: Column) -> Column:
    """Blocks whose head does not itself lie inside an active block above."""
    start = F.filter(F.array_repeat(F.get(blocks, F.lit(0)), F.lit(1)), lambda b: F.lit(False))
    inside = lambda held, b: F.exists(held, lambda h: F.array_contains(h["handled"], b["n"]))
    return F.aggregate(blocks, start, lambda held, b: F.when(inside(held, b), held).otherwise(F.concat(held, F.array(b))))


def _line_ops(x: Column, taken: Column, known: Column, empty: Column) -> Column:
    """The facts of one line, in the order in which they act."""
    n = x["n"]
    has = lambda p: x["line"].rlike(pat(p))
    g = lambda p, k: _group(x, p, k)
    tag = lambda kind, name: F.concat(F.lit(kind), name)
    lhs, rhs = g(ASSIGNED, 1), F.btrim(g(ASSIGNED, 2))
    constant = F.when(rhs.rlike(pat(LITERAL)), 1).when(rhs.rlike(pat(SAFE_CALL)), 2).otherwise(0)
    source = F.array_contains(taken, lhs)
    assign = F.when(source, _op(n, 20, "stop")).when(rhs.rlike(pat(CALLED)), _op(n, 20, "call", lhs, held=words(rhs))).otherwise(_op(n, 20, "assign", lhs, at=constant, held=words(rhs), level=x["indent"]))

    def ternary() -> Column:
        emptied = F.transform(F.filter(empty, lambda e: e["n"] <= n), lambda e: F.regexp_extract(e["s"], pat(EMPTY_CONSTANT), 1))
        truth = let(resolve(F.btrim(g(TERNARY, 3)), known, n + 1), lambda c: static_truth(c, emptied))
        yes, no = words(g(TERNARY, 2)), words(g(TERNARY, 4))
        return let(truth, lambda t: F.when(t.isNull(), _op(n, 900, "either", g(TERNARY, 1), held=F.concat(yes, no))).otherwise(_op(n, 900, "branch", g(TERNARY, 1), held=F.when(t, yes).otherwise(no))))

    return F.array_compact(
        F.array(
            F.when(x["s"].rlike(BRANCH), _op(n, 0, "depth", level=x["indent"])),
            F.when(has(CONF_SET), _op(n, 1, "put", name=tag("c:", g(CONF_SET, 1)), key=g(CONF_SET, 3), held=F.array(g(CONF_SET, 4)))),
            F.when(has(CONF_GET), _op(n, 2, "get", g(CONF_GET, 1), tag("c:", g(CONF_GET, 2)), g(CONF_GET, 4))),
            F.when(has(KEY_SET), _op(n, 3, "put", name=tag("m:", g(KEY_SET, 1)), key=g(KEY_SET, 2), held=F.array(g(KEY_SET, 3)))),
            F.when(has(KEY_GET), _op(n, 4, "get", g(KEY_GET, 1), tag("m:", g(KEY_GET, 2)), g(KEY_GET, 3))),
            F.when(has(INDEX_GET), _op(n, 5, "index", g(INDEX_GET, 1), g(INDEX_GET, 2), at=g(INDEX_GET, 3).try_cast("int"), held=F.array(g(INDEX_GET, 2)))),
            F.when(has(LIST_NEW), _op(n, 6, "new", name=g(LIST_NEW, 1))),
            F.when(has(APPEND_NAME), _op(n, 7, "append", g(APPEND_NAME, 1), g(APPEND_NAME, 1), held=F.array(g(APPEND_NAME, 2)))).when(has(APPEND_TEXT), _op(n, 7, "append", g(APPEND_TEXT, 1), g(APPEND_TEXT, 1))),
            F.when(has(POP), _op(n, 8, "pop", name=g(POP, 1), at=g(POP, 2).try_cast("int"))),
            F.when(has(ASSIGNED), assign),
            F.when(has(TERNARY) & ~F.array_contains(taken, g(TERNARY, 1)), ternary()),
        )
    )


def program(lines: Column, taken: Column, active: Column, known: Column, empty: Column) -> Column:
    """All facts in order. Lines of active blocks act through their head only, which keeps direct inputs out of `if`s."""
    handled = F.flatten(F.transform(active, lambda b: b["handled"]))
    own = F.flatten(F.transform(F.filter(lines, lambda x: _is_code(x) & ~F.array_contains(handled, x["n"])), lambda x: _line_ops(x, taken, known, empty)))
    heads = F.flatten(F.transform(active, lambda b: F.transform(F.filter(b["taken"], lambda a: ~(b["is_if"] & F.array_contains(taken, a["lhs"]))), lambda a, i: _op(b["n"], i + 30, "branch", a["lhs"], held=a["words"]))))
    return F.concat(F.array(_op(F.lit(0), 0, "begin")), F.array_sort(F.concat(own, heads))).cast(_OPS)


_START = "struct<vars:array<string>,put:array<string>,tracked:array<string>,lists:map<string,array<boolean>>,skip:int,depth:int>"


def _step(st: Column, o: Column, taken: Column) -> Column:
    kind, lhs, name = o["kind"], o["lhs"], o["name"]
    hit = F.arrays_overlap(o["words"], st["vars"])
    slot = F.concat_ws("|", name, o["key"])
    tracked, in_slot = F.array_contains(st["tracked"], name), F.array_contains(st["put"], slot)
    items = F.try_element_at(st["lists"], name)
    element = F.get(items, o["at"])  # null: no such list or no such place
    free, cleared = ~F.array_contains(taken, lhs), (o["at"] == 1) | ((o["at"] == 2) & ~hit)
    gain = F.when(kind == "get", tracked & in_slot).when(kind == "index", F.coalesce(element, hit)).when(kind == "assign", hit & (o["at"] != 1)).when(kind.isin("append", "call", "branch", "either"), hit).otherwise(False)
    kill = F.when(kind == "get", tracked & ~in_slot & free).when(kind == "index", ~F.coalesce(element, F.lit(True)) & free).when(kind == "assign", cleared & (o["level"] <= st["depth"] + 1)).when(kind == "branch", ~hit).otherwise(False)
    names = F.when(gain, F.array_union(st["vars"], F.array(lhs))).when(kill, F.array_except(st["vars"], F.array(lhs))).otherwise(st["vars"])
    is_put = kind == "put"
    put = F.when(is_put & hit, F.array_union(st["put"], F.array(slot))).when(is_put, F.array_except(st["put"], F.array(slot))).otherwise(st["put"])
    without = F.concat(F.slice(items, F.lit(1), o["at"]), F.slice(items, o["at"] + 2, F.greatest(F.size(items) - o["at"] - 1, F.lit(0))))
    fresh = F.array().cast("array<boolean>")
    changed = F.when(kind == "new", fresh).when(kind == "append", F.concat(F.coalesce(items, fresh), F.array(hit))).when((kind == "pop") & (o["at"] < F.size(items)), without)
    lists = F.when(changed.isNotNull(), F.map_concat(F.map_filter(st["lists"], lambda k, _: k != name), F.map_from_arrays(F.array(name), F.array(changed)))).otherwise(st["lists"])
    ends = kind.isin("stop", "call", "index") | ((kind == "get") & tracked)
    after = F.struct(
        names.alias("vars"), put.alias("put"), F.when(is_put, F.array_union(st["tracked"], F.array(name))).otherwise(st["tracked"]).alias("tracked"), lists.alias("lists"),
        F.when(kind == "begin", 0).when(ends, o["n"]).otherwise(st["skip"]).alias("skip"), F.when(kind == "depth", o["level"]).otherwise(st["depth"]).alias("depth"),
    )
    return F.when((o["n"] == st["skip"]) & (kind != "begin"), st).otherwise(after)


def _swept(facts: Column, state: Column, taken: Column) -> Column:
    """The state after SWEEPS folds. A fold that changes nothing would change nothing again, so it is the last."""
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c] == b[c] for c in ("vars", "put", "tracked", "skip", "depth"))) & (F.map_entries(a["lists"]) == F.map_entries(b["lists"]))
    once = lambda st: F.aggregate(facts, st, lambda s, o: _step(s, o, taken))
    sweep = lambda a, _: F.when(a["done"], a).otherwise(let(once(a["state"]), lambda s: F.struct(s.alias("state"), same(s, a["state"]).alias("done"))))
    return F.aggregate(F.array_repeat(F.lit(0), SWEEPS), F.struct(state.alias("state"), F.lit(False).alias("done")), sweep)["state"]


def tainted(files: DataFrame) -> DataFrame:
    """Adds `lines` and `vars`, what is tainted at the end. No filter stands on these columns: Spark would push it below
    them, and with it all they are made of."""
    out = files.withColumn("lines", numbered(F.col("code"))).withColumn("taken", sources(F.col("lines")))
    out = out.withColumn("known", constants(F.col("lines"))).withColumn("empty", F.filter("lines", lambda x: x["s"].rlike(pat(EMPTY_CONSTANT))))
    out = out.withColumn("heads", _heads(F.col("lines"), F.col("known"), F.col("empty"))).withColumn("active", _active(_blocks(F.col("lines"), F.col("heads"))))
    out = out.withColumn("program", program(F.col("lines"), F.col("taken"), F.col("active"), F.col("known"), F.col("empty")))
    empty = F.from_json(F.lit('{"vars": [], "put": [], "tracked": [], "lists": {}, "skip": 0, "depth": 0}'), _START)
    out = out.withColumn("state", F.struct(F.col("taken").alias("vars"), *(empty[c].alias(c) for c in ("put", "tracked", "lists", "skip", "depth"))))
    out = out.withColumn("state", _swept(F.col("program"), F.col("state"), F.col("taken")))
    return out.withColumn("vars", F.col("state.vars")).drop("taken", "known", "empty", "heads", "active", "program", "state")


def _overlap(c: Column) -> Column:
    return F.arrays_overlap(words(c), F.col("vars"))


def _span(first: Column, n: Column) -> Column:
    return F.slice("lines", first, F.greatest(n, F.lit(0)))


def _reached(flow: Flow, x: Column) -> Column:
    """Whether taint reaches the sink on line x."""
    if flow.category == "sqli":
        built = F.exists(
            _span(F.greatest(x["n"] - SQL_BACK, F.lit(2)), F.least(x["n"] - 1, F.lit(SQL_BACK + 1))),
            lambda y: _overlap(y["line"]) & ((y["line"].rlike(pat(SQL_TEXT)) & F.contains(x["line"], F.regexp_extract(y["line"], pat(SQL_TEXT), 1))) | y["line"].rlike(r"%|\.format\(")),
        )
        return built | (x["line"].rlike(pat(SQL_INLINE)) & _overlap(x["line"]))
    if flow.category == "xss":
        open_ = lambda c: F.length(F.regexp_replace(c, r"[^(]", "")) - F.length(F.regexp_replace(c, r"[^)]", ""))
        start = F.struct(open_(x["line"]).alias("open"), x["line"].alias("text"))
        step = lambda st, y: F.when(st["open"] <= 0, st).otherwise(F.struct((st["open"] + open_(y["line"])).alias("open"), F.concat(st["text"], F.lit("\n"), y["line"]).alias("text")))
        rest = F.when(open_(x["line"]) > 0, F.slice("lines", x["n"] + 1, F.size("lines"))).otherwise(F.slice("lines", F.lit(1), F.lit(0)))
        escaped = lambda c: F.regexp_extract_all(c, F.lit(pat(flow.safe[0])), 1)
        return let(F.aggregate(rest, start, step)["text"], lambda block: F.size(F.array_except(F.array_intersect(words(block), F.col("vars")), escaped(block))) > 0)
    low = F.greatest(x["n"] - REGION_BEFORE, F.lit(1))
    return _overlap(F.array_join(F.transform(_span(low, x["n"] + REGION_AFTER - low + 1), lambda y: y["line"]), "\n"))


def general_flow(files: DataFrame) -> DataFrame:
    """One finding per category and line."""
    own = files.filter(F.col("language").isin(*LANGUAGES)).select("file_id", "code", digest("code").alias("text_id"))
    some = once(own, "code").filter(F.col("code").rlike(pat(INPUT)))
    some = some.filter(reduce(lambda a, b: a | b, (F.col("code").rlike(pat(p)) for f in FLOWS for p in f.patterns)))

    def hits(flow: Flow) -> Column:
        sink = lambda x: reduce(lambda a, b: a | b, (x["line"].rlike(pat(p)) for p in flow.patterns))
        safe = lambda x: reduce(lambda a, b: a | b, (x["line"].rlike(pat(p)) for p in flow.safe), F.lit(False))
        names = ("category", "vulnerability_type", "severity", "cwe_id")
        return F.transform(F.filter("lines", lambda x: _is_code(x) & sink(x) & ~safe(x) & _reached(flow, x)), lambda x: F.struct(x["n"].alias("line_number"), *(F.lit(getattr(flow, c)).alias(c) for c in names)))

    found = tainted(some).select("text_id", F.array_join(F.array_sort("vars"), ",").alias("tainted_vars"), F.inline(F.concat(*map(hits, FLOWS))))
    return for_all(own, found).select("file_id", "line_number", "category", F.lit("GeneralFlowDetector").alias("detector_name"), "vulnerability_type", "severity", "cwe_id", F.lit(0.9).alias("confidence"), "tainted_vars")
