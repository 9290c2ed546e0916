"""Queries over general flow and static conditions. Files and conditions are also made from rows of a table, so that SQL can say
from the same rows what must come out, without following any flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.conditions import static_truth
from ..operators.general_flow import general_flow
from .flows import all_files
from .scanning import _q

#: Conditions by place, over whole numbers a to d, and the same in SQL.
CONDITIONS = (
    ("{a} * {b} + {c} > {d} * 5", "a * b + c > d * 5"),
    ("({a} + {b}) * {c} <= {d} - {b}", "(a + b) * c <= d - b"),
    ("{a} % ({b} + 1) == {c}", "a % (b + 1) = c"),
    ("{a} // ({b} + 1) - -{c} < {d}", "a // (b + 1) + c < d"),
    ("{b} < {c} < {d}", "b < c AND c < d"),
    ("{a} - {b} - {c}", "a - b - c <> 0"),
    ("{a} / {b} > {c}", "CASE WHEN b <> 0 THEN CAST(a AS DOUBLE) / b > c END"),
    ("'{c}' in \"{a}\"", "contains(CAST(a AS VARCHAR), CAST(c AS VARCHAR))"),
    ("'{c}' not in '{a}'", "NOT contains(CAST(a AS VARCHAR), CAST(c AS VARCHAR))"),
    ("{a} +", "CAST(NULL AS BOOLEAN)"),
)
_NUMBERS = "l_partkey % 37 AS a, l_suppkey % 5 AS b, l_linenumber AS c, CAST(l_quantity AS BIGINT) AS d"


def _made(rows: DataFrame, place: Column, templates: list[str], *fields: str) -> DataFrame:
    """Adds `place` and `made`, the template of the place with {field} replaced by the row's values."""
    known = rows.sparkSession.createDataFrame(list(enumerate(templates)), "place int, made string")  # some dozens
    made = F.col("made")
    for name in fields:
        made = F.replace(made, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return rows.withColumn("place", place.cast("int")).join(F.broadcast(known), "place").withColumn("made", made)


@query(f"""SELECT l_orderkey, l_linenumber, place, truth FROM (SELECT l_orderkey, l_linenumber, CAST((l_orderkey + l_linenumber) % {len(CONDITIONS)} AS INTEGER) AS place,
CASE (l_orderkey + l_linenumber) % {len(CONDITIONS)} {" ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(CONDITIONS))} END AS truth FROM (SELECT l_orderkey, l_linenumber, {_NUMBERS} FROM lineitem))""")
def static_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of a condition made from each line item."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(x.strip() for x in _NUMBERS.split(", ")))
    made = _made(rows, (F.col("l_orderkey") + F.col("l_linenumber")) % len(CONDITIONS), [t for t, _ in CONDITIONS], "a", "b", "c", "d")
    return made.select("l_orderkey", "l_linenumber", "place", static_truth(F.col("made"), F.array().cast("array<string>")).alias("truth"))


_PAD = "# a\n# b\n# c\n# d\n# e\n# f\n"
_IN = "p = request.form.get('q')\n"
#: Files by place: code over the numbers a, b and the letter e; when a finding is due (SQL), its line and its category.
FILES = (
    (_IN + "os.system(p)", "true", 2, "cmdi"),
    (_IN + "bar = p\nbar = 'ok{a}'\n" + _PAD + "eval(bar)", "false", 0, ""),
    (_IN + "bar = p\nif flag:\n    pass\n    bar = 'ok'\n" + _PAD + "eval(bar)", "true", 12, "codeinj"),  # the branch may not run
    (_IN + "bar = p + '{a}'\n" + _PAD + "exec(bar)", "true", 9, "codeinj"),
    (_IN + "lim = 1\nlim = {b}\nif {a} * 2 > lim * 3:\n    bar = p\nelse:\n    bar = 'ok'\nlim = 0\n" + _PAD + "os.popen(bar)", "a * 2 > b * 3", 15, "cmdi"),
    (_IN + "bar = p if {a} - {b} >= 4 else 'ok'\n" + _PAD + "redirect(bar)", "a - b >= 4", 9, "redirect"),
    (_IN + "conf.set('s', 'k0', p)\nconf.set('s', 'k1', other)\nbar = conf.get('s', 'k{e}')\n" + _PAD + "codecs.open(bar)", "e = 0", 11, "pathtraver"),
    (_IN + "m['k0'] = other\nm['k1'] = p\nbar = m['k{e}']\n" + _PAD + "conn.search(bar)", "e = 1", 11, "ldapi"),
    (_IN + "lst = []\nlst.append('safe')\nlst.append(p)\nlst.append('more')\nlst.pop(0)\nbar = lst[{e}]\n" + _PAD + "tree.xpath(bar)", "e <> 1", 14, "xpathi"),
    (_IN + "letters = 'ABC'\nguess = letters[{e}]\nmatch guess:\n    case 'A':\n        bar = p\n    case 'C' | 'D':\n        bar = p + '!'\n    case _:\n        bar = 'x'\n" + _PAD + "pickle.loads(bar)", "false", 0, ""),
    (_IN + "letters = 'ABC'\nguess = letters[{e}]\nmatch guess:\n    case 'A' | 'C':\n        bar = p\n    case 'B':\n        bar = 'x'\n" + _PAD + "marshal.loads(bar)", "e <> 1", 15, "deserialization"),
    (_IN + "bar = p\n" + _PAD + "sql = f'SELECT {x} WHERE id={a}'\ncur.execute(sql)", "false", 0, ""),
    (_IN + "bar = p\n" + _PAD + "sql = f'SELECT {bar}'\ncur.execute(sql)", "true", 10, "sqli"),
    (_IN + "bar = p\n" + _PAD + "sql = f'SELECT ?'\ncur.execute(sql, (bar,))", "false", 0, ""),
    (_IN + "bar = p\n" + _PAD + "RESPONSE += (\n    f'<b>'\n    f'{bar}'\n)", "true", 9, "xss"),
    (_IN + "bar = p\n" + _PAD + "RESPONSE += (\n    escape_for_html(bar)\n)", "false", 0, ""),
    ("p = helpers.separate_request.request_wrapper(request)\nsession['u{a}'] = p", "true", 2, "trustbound"),
    (_IN + "if 'k' in 'keys{a}':\n    bar = 'ok'\nelse:\n    bar = p\nbar = str(bar)\n" + _PAD + "yaml.load(bar)", "false", 0, ""),
)
_FIELDS = "o_orderkey % 41 AS a, o_custkey % 23 AS b, o_custkey % 3 AS e"


def _due(column: int) -> str:
    return f"CASE o_orderkey % {len(FILES)} " + " ".join(f"WHEN {k} THEN {_q(f[column]) if column == 3 else f[column]}" for k, f in enumerate(FILES)) + " END"


@query(f"""SELECT o_orderkey AS file_id, CAST({_due(2)} AS INTEGER) AS line_number, {_due(3)} AS category FROM (SELECT o_orderkey, {_FIELDS} FROM orders) WHERE {_due(1)}""")
def flow_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General flow over a file made from each order."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(x.strip() for x in _FIELDS.split(", ")))
    made = _made(rows, F.col("o_orderkey") % len(FILES), [f[0] for f in FILES], "a", "b", "e")
    files = made.select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.col("made").alias("code"))
    return general_flow(files).select("file_id", "line_number", "category")


@query()
def det_general_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the documents and the snippets. No SQL; `flow_of_orders` has it, and tests follow random files by brute force."""
    return general_flow(all_files(spark, sf_dir))
