"""General flow and static conditions against versions that follow a file line by line."""

import random
import re

from pyspark.sql import functions as F

from lumenscan.functions.conditions import arithmetic
from lumenscan.operators.general_flow import FLOWS, INPUT, general_flow


def test_arithmetic(spark):
    r = random.Random(1)

    def expression(depth):
        k = r.random()
        if depth == 0 or k < 0.25:
            return str(r.randrange(30))
        if k < 0.4:
            return f"({expression(depth - 1)})" if k < 0.35 else "-" + expression(depth - 1)
        return expression(depth - 1) + r.choice([" + ", "-", " * ", " / ", "%", " // ", " < ", ">", "<=", "==", "!="]) + expression(depth - 1)

    texts = [expression(4) for _ in range(300)] + ["", "(", ")", "1 2", "3 +", "7 * 18 + 106 > 200", "007", "00", "1 < 2 < 3", "(3 > 2) > 1", "- - 3", "5 / 0", "5 > 9 > 5 / 0", "1 = 2", "!3", "5(3)"]
    want = {}
    for t in texts:
        try:
            want[t] = bool(eval(t))
        except Exception:
            want[t] = None
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {x.t: x.v for x in frame.select("t", arithmetic(F.col("t")).alias("v")).collect()} == want
    powers = spark.createDataFrame([("2 ** 3",), ("2 << 3",)], "t string")
    assert {x.v for x in powers.select(arithmetic(F.col("t")).alias("v")).collect()} == {None}


class Walk:
    """One file, by a machine that runs line after line. Conditions are numbers only, so eval tells them."""

    def __init__(self, code):
        self.rows = code.split("\n")
        self.dirty, self.inputs = set(), set()
        for row in self.rows:
            if m := re.search(INPUT, row):
                self.inputs.add(m[1])
            if (m := re.search(r"(\w+)\s*=\s*(\w+)\s*\[\s*\d+\s*\]", row)) and m[2] in self.inputs:
                self.inputs.add(m[1])
        self.dirty |= self.inputs
        self.conf, self.maps, self.lists, self.skip, self.depth = {}, {}, {}, set(), 0
        if self.inputs:
            for _ in range(4):
                for at in range(len(self.rows)):
                    if at not in self.skip and (s := self.rows[at].strip()) and s[0] != "#":
                        self.line(at, s)

    def uses(self, text):
        return bool(set(re.findall(r"\w+", text)) & self.dirty)

    def set(self, name, on):
        (self.dirty.add if on else self.dirty.discard)(name)

    def line(self, at, s):
        row = self.rows[at]
        indent = len(row) - len(row.lstrip())
        if s.startswith(("if ", "elif ", "else:")):
            self.depth = indent
        for store, put, get in ((self.conf, r"(\w+)\.set\('\w+', '(\w+)', (\w+)\)", r"(\w+) = (\w+)\.get\('\w+', '(\w+)'\)"), (self.maps, r"(\w+)\['(\w+)'\] = (\w+)", r"(\w+) = (\w+)\['(\w+)'\]")):
            if m := re.search(put, row):
                store.setdefault(m[1], {})[m[2]] = m[3] in self.dirty
            if (m := re.search(get, row)) and m[2] in store:
                if store[m[2]].get(m[3]):
                    self.dirty.add(m[1])
                elif m[1] not in self.inputs:
                    self.dirty.discard(m[1])
                return
        if m := re.match(r"\s*(\w+) = (\w+)\[(\d+)\]", row):
            held = self.lists.get(m[2])
            if held is not None and int(m[3]) < len(held):
                if held[int(m[3])] or m[1] not in self.inputs:
                    self.set(m[1], held[int(m[3])])
            elif m[2] in self.dirty:
                self.dirty.add(m[1])
            return
        if m := re.match(r"\s*(\w+) = \[\]", row):
            self.lists[m[1]] = []
        if m := re.search(r"(\w+)\.append\((\w+|'\w+')\)", row):
            on = m[2] in self.dirty
            self.lists.setdefault(m[1], []).append(on)
            if on:
                self.dirty.add(m[1])
        if (m := re.search(r"(\w+)\.pop\((\d+)\)", row)) and int(m[2]) < len(self.lists.get(m[1], [])):
            self.lists[m[1]].pop(int(m[2]))
        if m := re.match(r"\s*(\w+) = (.*)", row):
            name, right = m[1], m[2].strip()
            if name in self.inputs:
                return
            hit = self.uses(right)
            if re.match(r"\w+\.\w+\(", right):
                if hit:
                    self.dirty.add(name)
                return
            constant = bool(re.fullmatch(r"'.*'|\d+\.?\d*", right)) or (re.match(r"(str|int|len)\(", right) and not hit)
            if hit and not constant:
                self.dirty.add(name)
            elif constant and indent <= self.depth + 1:
                self.dirty.discard(name)
        if m := re.match(r"if (.+):", s):
            truth = self.truth(m[1])
            if truth is not None:
                self.branch(at, indent, truth)
        if m := re.match(r"\s*(\w+) = (.+?) if (.+?) else (.+)", row):
            truth = self.truth(m[3])
            if truth is None:
                if self.uses(m[2] + " " + m[4]):
                    self.dirty.add(m[1])
            else:
                self.set(m[1], self.uses(m[2] if truth else m[4]))

    def truth(self, text):
        return bool(eval(text)) if re.fullmatch(r"[\d\s<>+*]+", text) else None

    def branch(self, at, indent, truth):
        on = truth
        for j in range(at + 1, min(len(self.rows), at + 30)):
            row, s = self.rows[j], self.rows[j].strip()
            if not s:
                continue
            deep = len(row) - len(row.lstrip())
            if deep == indent and s.startswith("else:"):
                on = not truth
                self.skip.add(j)
                continue
            if (deep == indent and s.startswith("elif ")) or (deep <= indent and s[0] != "#"):
                return
            self.skip.add(j)
            if on and (m := re.match(r"\s*(\w+) = (.*)", row)) and m[1] not in self.inputs:
                self.set(m[1], self.uses(m[2]))

    def findings(self):
        out = set()
        for at, row in enumerate(self.rows):
            if not row.strip() or row.strip()[0] == "#":
                continue
            for f in FLOWS:
                if f.category in ("sqli", "xss") or any(re.search(p, row) for p in f.safe) or not any(re.search(p, row) for p in f.patterns):
                    continue
                if self.uses("\n".join(self.rows[max(0, at - 5) : at + 4])):
                    out.add((at + 1, f.category))
        return out


def test_random_files(spark):
    r = random.Random(4)
    names = "abcd"

    def statement():
        x, y, k = r.choice(names), r.choice(names + "p"), r.randrange(3)
        return r.choice(
            [f"{x} = {y}", f"{x} = {y} + '1'", f"{x} = 'text'", f"{x} = {k}", f"{x} = str({y})", f"{x} = obj.make({y})", f"{x} = {y} if {k} > 1 else 'n'", f"{x} = 'n' if flag else {y}", f"conf.set('s', 'k{k}', {y})", f"{x} = conf.get('s', 'k{k}')"]
            + [f"m['k{k}'] = {y}", f"{x} = m['k{k}']", "l = []", f"l.append({y})", "l.append('t')", f"l.pop({k})", f"{x} = l[{k}]", f"{x} = request.args.get('z')", "# note", "", f"{x} = {y}[0]"]
        )

    files = []
    for k in range(150):
        rows = ["p = request.form.get('q')"]
        for _ in range(r.randrange(3, 14)):
            if r.random() < 0.25:
                rows += [f"if {r.choice(['flag', '3 > 2', '1 + 1 > 2 * 3'])}:", *("    " + statement() for _ in range(r.randrange(1, 3)))]
                rows += ["else:", *("    " + statement() for _ in range(r.randrange(1, 3)))] if r.random() < 0.6 else []
            else:
                rows.append(statement())
        for sink in r.sample(["os.system({})", "eval({})", "open({})", "redirect({})", "pickle.loads({})", "conn.search({})", "tree.xpath({}.replace('&apos;', x))"], 3):
            rows += ["#"] * 6 + [sink.format(r.choice(names))]
        files.append((k, "f.py", "python", "\n".join(rows)))
    files += [(900, "f.py", "python", ""), (901, "f.py", "python", None), (902, "f.md", "text", "p = input()\neval(p)"), (903, "f.py", "python", "p = input()\n" + "x = p\n" * 3000 + "eval(x)")]
    got = {}
    for x in general_flow(spark.createDataFrame(files, "file_id long, path string, language string, code string")).collect():
        got.setdefault(x.file_id, set()).add((x.line_number, x.category))
    want = {k: w for k, _, language, code in files if language == "python" and (w := Walk(code or "").findings())}
    assert got == want


def test_rows_are_dealt_by_number(spark):
    """A table of few bytes is one partition; its files take long all the same."""
    from lumenscan.functions import text

    rows = spark.range(30).coalesce(1).withColumnRenamed("id", "o_orderkey")
    got = text.dealt(rows, "o_orderkey")
    assert got.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and sorted(r.o_orderkey for r in got.collect()) == [*range(30)]


def test_equal_texts_are_followed_once(spark):
    """Each file has its findings, null and repeated numbers too; of equal texts one is followed."""
    codes = ["p = input()\neval(p)", "p = input()\n\neval(p)", "p = 1\neval(p)"]
    files = [(k, f"f{k}.py", "python", codes[k % 3]) for k in range(60)] + [(None, "a.py", "python", codes[0]), (0, "b.py", "javascript", codes[0]), (99, "c.py", "python", None), (98, "c.md", "text", codes[0])]
    found = general_flow(spark.createDataFrame(files, "file_id long, path string, language string, code string"))
    want = [(k, 2 + k % 3, "codeinj", "p") for k in range(60) if k % 3 < 2] + [(None, 2, "codeinj", "p"), (0, 2, "codeinj", "p")]
    assert sorted(map(repr, map(tuple, found.select("file_id", "line_number", "category", "tainted_vars").collect()))) == sorted(map(repr, want))
    texts = [f for f in found.inputFiles() if "texts" in f]
    assert sorted(r.code or "" for r in spark.read.parquet(*texts).collect()) == ["", *sorted(codes)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_digests_tell_columns_apart(spark):
    from lumenscan.operators.copies import digest

    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), (None, None), ("1:a", "b"), ("-", "-"), ("é", "b")]
    got = spark.createDataFrame(rows, "a string, b string").select(digest("a", "b").alias("d")).distinct()
    assert got.count() == len(rows) and not got.schema["d"].nullable
