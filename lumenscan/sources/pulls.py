"""Changed files of pull requests: a data source over the REST interface of a code host.

    pull_requests(spark, repo="owner/name", numbers="1,2,7", extensions="py,js").filter("endswith(filename, '_api.py')")

Each task asks for some of the pull requests: the head's commit, the list of files page by page, and the body of every text
file that was not removed. What a request does not need is not asked for: filters on `number` and on the end of
`filename`, and the extensions, hold at the reader, before bodies are fetched.

Defined cases: a pull request that cannot be read gives one row with its error and no file; a body that cannot be read, or a file
without a patch (binary, or only renamed), has a null content; a file without a patch has an empty one; without numbers
there are no rows."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.error import URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith

from .diffs import changed_lines

SCHEMA = "number long, filename string, status string, patch string, content string, error string"
API = "https://api.github.com"
#: The extensions that a scan of a pull request takes where none are given.
EXTENSIONS = ("py", "js", "ts")
PAGE = 100


def extension(name: str) -> str:
    """What follows the last dot of the last part of a path; empty for hidden files and names without a dot."""
    head, dot, tail = name.rsplit("/", 1)[-1].rpartition(".")
    return tail if head and dot else ""


class _Pulls(InputPartition):
    def __init__(self, numbers: list[int]):
        super().__init__(numbers)


class PullRequestReader(DataSourceReader):
    def __init__(self, options):
        self.api = options.get("api", API).rstrip("/")
        self.repo = options["repo"]
        self.token = options.get("token", "")
        self.timeout = float(options.get("timeout", "30"))
        self.per_task = max(1, int(options.get("pullsPerTask", "8")))
        self.numbers = sorted({int(x) for x in options.get("numbers", "").split(",") if x.strip()})
        self.extensions = {x.strip().lstrip(".") for x in options.get("extensions", "").split(",") if x.strip()}
        self.endings: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("number",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.numbers = [n for n in self.numbers if n in wanted]
            elif isinstance(f, StringEndsWith) and f.attribute == ("filename",):
                self.endings.append(f.value)
            else:
                yield f  # Spark's own work

    def partitions(self):
        return [_Pulls(self.numbers[k : k + self.per_task]) for k in range(0, len(self.numbers), self.per_task)]

    def _get(self, path: str):
        headers = {"Accept": "application/vnd.github+json"}
        if self.token:
            headers["Authorization"] = f"Bearer {self.token}"
        with urlopen(Request(f"{self.api}/repos/{self.repo}/{path}", headers=headers), timeout=self.timeout) as reply:
            return json.load(reply)

    def _content(self, name: str, head: str) -> str | None:
        try:
            return base64.b64decode(self._get(f"contents/{quote(name)}?ref={head}")["content"]).decode("utf-8", "replace")
        except (URLError, TimeoutError, ValueError, KeyError, TypeError):
            return None

    def read(self, partition: _Pulls | None) -> Iterator[tuple]:
        for number in partition.value if partition else ():  # without partitions Spark runs one task on None
            # a list that breaks off half-way is an error of the whole pull request, so its files are held back until it is whole
            try:
                head, files, page = self._get(f"pulls/{number}")["head"]["sha"], [], 1
                while part := self._get(f"pulls/{number}/files?per_page={PAGE}&page={page}"):
                    files += part
                    page += 1
                    if len(part) < PAGE:
                        break
            except (URLError, TimeoutError, ValueError, KeyError, TypeError) as e:
                if not self.endings:
                    yield number, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            for f in files:
                name, status, patch = f.get("filename") or "", f.get("status"), f.get("patch") or ""
                if self.extensions and extension(name) not in self.extensions or not all(name.endswith(e) for e in self.endings):
                    continue
                content = self._content(name, head) if patch and name and status != "removed" else None
                yield number, name, status, patch, content, None


class PullRequests(DataSource):
    """Pull requests by number; the options are those of the module's example, and token, timeout, pullsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PullRequestReader:
        return PullRequestReader(self.options)


def pull_requests(spark: SparkSession, **options: str) -> DataFrame:
    """The source registered, and Spark told to hand filters to Python readers, without which it refuses this one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PullRequests)
    return spark.read.format("pull_requests").options(**options).load()


def in_scope(extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a changed file is scanned: it has a body and one of the extensions."""
    return F.col("content").isNotNull() & F.regexp_extract("filename", r"(?:^|/)[^/]+\.([^./]+)$", 1).isin(*extensions)


def changed_in_pulls(files: DataFrame) -> DataFrame:
    """number, filename, line_no of each line that the patches add. A file's patch has hunks only, so its header is set before it."""
    diffs = files.select(F.struct("number", "filename").alias("diff_id"), F.concat(F.lit("+++ b/"), "filename", F.lit("\n"), "patch").alias("text"))
    return changed_lines(diffs).select("diff_id.number", "diff_id.filename", "line_no")
