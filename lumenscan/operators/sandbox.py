"""Path results laid into findings, fixes from paths, and the run in five phases: detect, analyse, fix, detect again, assemble.

Every step is a join or a window by file and line. The second detection scans only files that a fix has changed; what the
first one found in the others is joined in by phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grown
from ..sources.warehouse import written as _written
from . import remediate as R
from . import taint as T
from .detectors import _OWNERS
from .union import COLUMNS, all_findings, narrowed

PIPELINE = "StaticAnalysisPipeline"
#: What a path adds to a finding.
REACHED = "reachability_status string, reachability_reasoning string, attack_path string, sink_api string"
_RANK = {"Confirmed Reachable": 4, "Requires Manual Review": 3, "Unverifiable": 2, "Reachability Eliminated": 1}
# Nodes where tainted data enters a text, by kind of syntax node or by name; forms of calls that fixes take.
TEXT_NODES, TEXT_NAMES = ("JoinedStr", "BinOp", "Call"), ("f-string", "concat", ".format()", "%-format")
EXECUTED = r"^(.*?\.execute\s*\(\s*\w+\s*)\)\s*$"
SHELL_TRUE = r"^(.*?subprocess\.(?:check_output|run|call|Popen)\s*\(\s*)[^,\)]+\s*,\s*shell\s*=\s*True\s*\)(.*)$"
SYSTEM = r"os\.system\s*\(\s*[^)]+\s*\)"


def path_results(files: DataFrame) -> DataFrame:
    """Attack paths with their status and its reason; result_id is their order in the file: by source, then sink, then path."""
    paths = T.attack_paths(T.facts(files)).join(grown(files.select("file_id", "code")), "file_id")
    reach = T.reach_status(F.col("vulnerability_type"), F.col("code"), F.col("source_line"), F.col("sink_line"))
    order = Window.partitionBy("file_id").orderBy("source_line", "source_name", "sink_line", "sink_name", "path_id")
    rows = paths.withColumn("r", reach).drop("code").withColumn("result_id", F.row_number().over(order).cast("long"))
    reason = T.reasoning(F.col("r.status"), F.col("r.sanitizers"), F.col("source_name"), F.col("source_line"), F.col("sink_name"), F.col("sink_line"))
    at = lambda name, line: F.concat(name, F.lit(":"), line.cast("string"))
    text = F.array_join(F.concat(F.array(at(F.col("source_name"), F.col("source_line"))), F.transform("transforms", lambda t: at(t["name"], t["line"])), F.array(at(F.col("sink_name"), F.col("sink_line")))), " > ")
    known = T.sink_info(F.col("sink_name")).isNotNull()
    return rows.select(
        "file_id", "result_id", "source_name", "source_line", "sink_name", "sink_line", "transforms", "vulnerability_type", "severity", "cwe_id", known.alias("known"),
        F.col("r.status").alias("reachability_status"), reason.alias("reachability_reasoning"), text.alias("attack_path"), F.col("sink_name").alias("sink_api"),
    )


_LAID = [f.split()[0] for f in REACHED.split(", ")]


def _plain(findings: DataFrame) -> DataFrame:
    return findings.select("*", *(F.lit(None).cast("string").alias(c) for c in _LAID))


_TYPED = ("vulnerability_type", "severity", "cwe_id")


def _laid(c: str, old: Column, new: Column, kind: Column) -> Column:
    """A finding's column under what a result has for it."""
    return F.coalesce(new[c], old) if c in _LAID else F.coalesce(kind[c], old) if c in _TYPED else old


def _over(findings: DataFrame, by_id: DataFrame) -> DataFrame:
    """Findings with what by_id (file_id, finding_id, REACHED, kind: struct of the types to set or null) has for them."""
    new = by_id.select("file_id", "finding_id", F.struct(*_LAID).alias("_new"), F.col("kind").alias("_kind"))
    joined = findings.join(grown(new), ["file_id", "finding_id"], "left")
    return joined.select(*(_laid(c, F.col(c), F.col("_new"), F.col("_kind")).alias(c) for c in findings.columns))


def _alone(findings: DataFrame, of=F.col) -> dict[str, Column]:
    """The columns of findings, of a result whose columns `of` gives, as a finding of its path alone; such stand behind all others."""
    made = {
        "line_number": of("sink_line"), "detector_name": F.lit(PIPELINE), "confidence": F.lit(0.9), "det_ord": F.lit(1 << 20), "finding_id": of("result_id") + F.lit(1 << 40),
    }
    return {c: made[c].cast(findings.schema[c].dataType) if c in made else of(c) for c in findings.columns}


def _all_alone(results: DataFrame, findings: DataFrame) -> DataFrame:
    return results.select(*(v.alias(c) for c, v in _alone(findings).items()))


def _kind(of=F.col) -> Column:
    return F.when(of("known"), F.struct(*(of(c).alias(c) for c in _TYPED)))


def lay_exclusive(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Each result in order takes one finding (see `taint.taken`) and sets its status, path and sink, and its type, severity and
    CWE where the sink is known; a result that finds none free becomes a finding of its own.

    Findings and results meet once, as arrays by file, so each row is dealt once at most."""
    plain = _plain(findings)
    whole = F.struct("result_id", *(c for c in results.columns if c != "result_id"))
    asked = results.filter("file_id is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(whole)).alias("rs"))
    held = plain.groupBy("file_id").agg(F.collect_list(F.struct(*plain.columns)).alias("fs"))
    sides = (held, "fs"), (asked, "rs")
    rows = held.join(grown(asked), "file_id", "full").select(*(F.coalesce(c, F.array().cast(side.schema[c].dataType)).alias(c) for side, c in sides))
    wants = F.transform("rs", lambda r: F.struct(r["sink_line"].alias("sink_line"), F.lower(r["vulnerability_type"]).alias("type"), F.transform(r["transforms"], lambda t: t["line"]).alias("lines"), r["source_line"].alias("source_line")))
    free = F.transform("fs", lambda f: F.struct(f["finding_id"].cast("long").alias("finding_id"), f["line_number"].alias("line"), F.lower(f["vulnerability_type"]).alias("type")))
    rows = rows.withColumn("picks", T.taken(wants, free))
    none = F.lit(None).cast(held.schema["fs"].dataType.elementType)
    over = F.transform("fs", lambda f: F.struct(f.alias("f"), F.try_element_at("rs", F.nullif(F.array_position("picks", f["finding_id"]), F.lit(0)).cast("int")).alias("r")))
    alone = F.transform(F.filter("rs", lambda r, i: F.col("picks")[i].isNull()), lambda r: F.struct(none.alias("f"), r.alias("r")))
    pairs = rows.select(F.explode(F.concat(over, alone)).alias("p")).select("p.f", "p.r")
    of = lambda c: F.col("r")[c]
    return pairs.select(*(F.when(F.col("f").isNull(), made).otherwise(_laid(c, F.col("f")[c], F.col("r"), _kind(of))).alias(c) for c, made in _alone(plain, of).items()))


def _by_line(results: DataFrame) -> DataFrame:
    """Per file and sink line: the first result, the last one, and the types of the last whose sink is known."""
    whole = F.struct(*results.columns)
    return results.groupBy("file_id", F.col("sink_line").alias("line_number")).agg(F.min_by(whole, "result_id").alias("first"), F.max_by(whole, "result_id").alias("last"), F.max_by(_kind(), F.when(F.col("known"), F.col("result_id"))).alias("kind"))


def _last_on(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(F.col("last")[c].alias(c) for c in _LAID))


def lay_last(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Each result in order is laid over the first finding on its sink's line, so the last one stays. Where there is none the first result
    makes one, and later results of that line are laid over it."""
    plain, lines = _plain(findings), _by_line(results)
    first = findings.groupBy("file_id", "line_number").agg(F.min("finding_id").alias("finding_id"))
    laid = _over(plain, _last_on(lines.join(grown(first), ["file_id", "line_number"])))
    made = lines.join(grown(first), ["file_id", "line_number"], "left_anti")
    rows = _all_alone(made.select("first.*"), plain)
    return laid.unionByName(_over(rows, _last_on(made.select("file_id", (F.col("first.result_id") + F.lit(1 << 40)).alias("finding_id"), "last", "kind"))))


def lay_missing(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Findings, with one of a path for each line that has none: the first result, which bars later ones."""
    plain = _plain(findings)
    made = _by_line(results).join(grown(findings.select("file_id", "line_number").distinct()), ["file_id", "line_number"], "left_anti")
    return plain.unionByName(_all_alone(made.select("first.*"), plain))


def dedup(findings: DataFrame, owners: bool = True) -> DataFrame:
    """The best finding of each file, line, type and sink: its owner's (scans of single files), then by status, then the surest,
    then the first."""
    kind = F.lower("vulnerability_type")
    key = F.when(kind == "attribute injection", "mass assignment").otherwise(kind)
    owner = F.create_map(*(F.lit(x) for pair in _OWNERS.items() for x in pair))
    owned = F.coalesce(F.try_element_at(owner, kind) == F.col("detector_name"), F.lit(False)) & F.lit(owners)
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair)), F.col("reachability_status")), F.lit(0))
    best = Window.partitionBy("file_id", "line_number", "_key", "_sink").orderBy(F.desc("_owned"), F.desc("_status"), F.desc("confidence"), "finding_id")
    rows = findings.withColumns({"_key": key, "_sink": F.coalesce("sink_api", F.lit("")), "_owned": owned, "_status": rank})
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_key", "_sink", "_owned", "_status", "_n")


def targets(results: DataFrame) -> DataFrame:
    """file_id, line_number, place (order among the targets of a line), type and result: lines that a fix of a confirmed path tries.

    SQL: where tainted data enters the text, and the sink. Prompts: where it enters, else the first transform, else the sink. The
    rest: the sink."""
    entries = F.transform(F.filter("transforms", lambda t: t["ast_type"].isin(*TEXT_NODES) | t["name"].isin(*TEXT_NAMES)), lambda t: t["line"])
    sink, kind = F.array("sink_line"), F.lower("vulnerability_type")
    first = F.when(F.size("transforms") > 0, F.array(F.col("transforms")[0]["line"])).otherwise(sink)
    of_sql = F.when(F.size(entries) > 0, F.array_distinct(F.concat(entries, sink))).otherwise(sink)
    lines = F.when(F.contains(kind, F.lit("sql injection")), of_sql).when(F.contains(kind, F.lit("prompt injection")), F.when(F.size(entries) > 0, entries).otherwise(first)).otherwise(sink)
    rows = results.filter("reachability_status = 'Confirmed Reachable'").select("file_id", "result_id", "vulnerability_type", "source_name", "sink_line", F.posexplode(lines).alias("pos", "line_number"))
    return rows.select("file_id", "line_number", F.struct("result_id", "pos").alias("place"), "vulnerability_type", "source_name", "sink_line")


def fix_from_path(kind: Column, line: Column, source: Column, at_sink: Column) -> Column:
    """The line with the path's source handed over as a parameter or as one argument; else the fix by type."""
    quoted = F.contains(line, F.lit("f'")) | F.contains(line, F.lit('f"'))
    executed = F.when(F.contains(F.lower(kind), F.lit("sql injection")) & at_sink & (source != "") & ~quoted & line.rlike(EXECUTED), F.concat(F.regexp_extract(line, EXECUTED, 1), F.lit(", ("), source, F.lit(",))")))
    listed = F.concat(F.lit("['ls', '-la', "), source, F.lit("]"))
    shell = F.when(line.rlike(SHELL_TRUE), F.concat(F.regexp_extract(line, SHELL_TRUE, 1), listed, F.lit(", shell=False)"), F.regexp_extract(line, SHELL_TRUE, 2)))
    system = F.when(line.rlike(SYSTEM), F.regexp_replace(line, F.lit(SYSTEM), F.concat(F.lit("subprocess.run("), listed, F.lit(", shell=False)"))))
    called = F.contains(line, F.lit("shell=True")) | F.contains(line, F.lit("os.system("))
    command = F.when(F.contains(F.lower(kind), F.lit("command injection")) & (source != "") & called, F.coalesce(shell, system))
    special = F.coalesce(executed, command)
    return F.coalesce(F.when(R.without_comments(special) != R.without_comments(line), special), R.fix(kind, line))


def fixes(files: DataFrame, results: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixed, diffs). Targets of paths first, in the order of results: the first fix that applies to a line is its one fix,
    targets before it are rejected with advice. Then the findings, for lines without a fix; a weak seed tries the line below.

    diffs: file_id, line_number, vulnerability_type, original_line, fixed_line, is_functional, advice. All line numbers are those of
    the code as it was: a fix of several lines moves no other."""
    lined = files.select("file_id", F.split("code", "\n", -1).alias("all"))
    line = F.try_element_at("all", F.col("line_number"))
    tried = targets(results).join(grown(lined), "file_id").withColumn("original_line", line).filter("original_line is not null")
    tried = tried.withColumn("fixed_line", fix_from_path(F.col("vulnerability_type"), F.col("original_line"), F.col("source_name"), F.col("line_number") == F.col("sink_line")))
    first = F.min(F.when(F.col("fixed_line").isNotNull(), F.col("place"))).over(Window.partitionBy("file_id", "line_number"))
    kept = tried.withColumn("chosen", first).filter("chosen is null or place <= chosen")
    one = ["file_id", "line_number", "vulnerability_type", "original_line"]
    of_paths = kept.select(*one, F.coalesce("fixed_line", "original_line").alias("fixed_line"), F.col("fixed_line").isNotNull().alias("is_functional"), F.when(F.col("fixed_line").isNull(), R.by_hand(F.col("vulnerability_type"), F.col("original_line"))).alias("advice"))
    done = of_paths.filter("is_functional").select("file_id", "line_number")
    asked = findings.select("file_id", "line_number", "vulnerability_type", "finding_id").join(grown(lined), "file_id").withColumn("own", line).filter("own is not null").join(grown(done), ["file_id", "line_number"], "left_anti")
    below = (F.col("vulnerability_type") == "Weak Random") & F.contains("own", F.lit("random.seed("))
    asked = asked.withColumn("asked_line", F.col("line_number")).withColumn("line_number", F.when(below, F.col("line_number") + 1).otherwise(F.col("line_number"))).withColumn("original_line", line)
    asked = asked.join(grown(done), ["file_id", "line_number"], "left_anti").withColumn("fixed_line", R.fix(F.col("vulnerability_type"), F.col("original_line"))).filter("fixed_line is not null")
    best = Window.partitionBy("file_id", "line_number").orderBy(F.desc("asked_line"), "finding_id")
    of_findings = asked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*one, "fixed_line", F.lit(True).alias("is_functional"), F.lit(None).cast("string").alias("advice"))
    diffs = of_paths.unionByName(of_findings)
    laid = diffs.filter("is_functional").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("line_number", "fixed_line"))).alias("fixes"))
    code = F.array_join(F.transform("all", lambda x, i: F.coalesce(F.try_element_at("fixes", i + 1), x)), "\n")
    return lined.join(grown(laid), "file_id").select("file_id", code.alias("code")), diffs


def detected(files: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """All detectors' findings with finding_id, their order in the file. Files are few or narrowed."""
    order = Window.partitionBy("file_id").orderBy("det_ord", "line_number", "vulnerability_type", "cwe_id", F.desc("confidence"))
    return all_findings(files, without, narrow=False).select(*COLUMNS, "det_ord", F.row_number().over(order).cast("long").alias("finding_id"))


def run(files: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(before, diffs, after) of files with file_id, path, language, code; file_id is unique.

    Files with a null code have no findings. The last phase compares by file and line, so a file without fixes loses at most
    what only the analysis of the first phase had changed in type. Files that no detector nor path can tell of leave first."""
    files = narrowed(files)
    found = _written(detected(files, without), "sandbox-found")
    results = _written(path_results(files), "sandbox-paths")
    of = lambda rows: dedup(rows, owners=False)
    before = _written(of(lay_last(of(_plain(found)).drop(*_LAID), results)), "sandbox-before")
    code, diffs = fixes(files, results, before)
    diffs, fixed = _written(diffs, "sandbox-diffs"), _written(code, "sandbox-fixed")
    changed = files.drop("code").join(grown(fixed), "file_id")
    again = found.join(grown(fixed.select("file_id")), "file_id", "left_anti").unionByName(detected(changed, without))
    reached = results.join(grown(fixed.select("file_id")), "file_id", "left_anti").unionByName(path_results(changed))
    after = of(lay_missing(of(_plain(again)).drop(*_LAID), reached))
    return before, diffs, after
