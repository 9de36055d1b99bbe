"""Landed listing pages: a Spark data source, and the items that sources listed on them.

A fetcher lands each answer below ``source=<name>/term=<keyword or category>/page=<n>/status=<http status>/``, in one file or several
that follow each other by name. ``LandedPages`` reads them: a task takes a range of pages of one term, and a page that can't be read
is a row that says why. Which terms and how many pages there may be comes from the settings; only for a search without a
limit of pages planning lists the names of the term's pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages that a task reads at most, rows of a batch, and the term of a search without one.
PAGES_A_TASK, BATCH_PAGES, ANY_TERM = 512, 16, "-"
#: Characters that folder names of partitions spell as % and two digits.
_ESCAPED = re.compile(r'[\x01-\x1f"#%\'*/:=?\\\x7f{\[\]^]')
PAGE = "source string, term string, page int, status int, body string, error string"
NOT_LANDED = "nothing landed"


@dataclass
class PageRange(InputPartition):
    """Pages ``first`` to ``after`` - 1 of a term."""

    source: str
    term: str
    first: int
    after: int


class LandedPages(DataSource):
    """``spark.read.format("landed_pages").options(path=..., wanted=...)``; ``wanted`` is JSON: source, term and most pages (null: all that landed) of each search."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], json.loads(self.options["wanted"]), int(self.options.get("pages_a_task", PAGES_A_TASK)))


class PageReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[list], pages_a_task: int):
        self.path, self.wanted, self.pages_a_task = path, wanted, pages_a_task

    def partitions(self) -> list[PageRange]:
        limits = [(source, term, self.landed(source, term) if most is None else most) for source, term, most in self.wanted]
        return [PageRange(source, term, first, min(first + self.pages_a_task, most)) for source, term, most in limits for first in range(0, most, self.pages_a_task)]

    def landed(self, source: str, term: str) -> int:
        """Pages up to the last one that landed; 1 if none did, for the row that says so."""
        return max((page + 1 for page, _ in self.numbered(source, term)[1]), default=1)

    def numbered(self, source: str, term: str):
        """The store, and number and place of each page of a term."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))
        seen = store.get_file_info(fs.FileSelector(f"{root}/source={escaped(source)}/term={escaped(term)}", allow_not_found=True))
        return store, sorted((int(f.base_name[5:]), f.path) for f in seen if re.fullmatch(r"page=\d+", f.base_name))

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        store, numbered = self.numbered(partition.source, partition.term)
        rows = [] if numbered or partition.first else [(0, None, None, NOT_LANDED)]
        for page, place in numbered:
            if partition.first <= page < partition.after:
                rows.append((page, *self.page(store, place)))
                if len(rows) == BATCH_PAGES:
                    yield self.batch(partition, rows)
                    rows = []
        if rows:
            yield self.batch(partition, rows)

    @staticmethod
    def page(store, place: str) -> tuple[int | None, str | None, str | None]:
        """Status and text of a page, or why it can't be read."""
        from pyarrow import fs

        try:
            files = [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
            status = {m.group(1) for f in files if (m := re.search(r"/status=(\d+)/", f.path))}
            if len(status) != 1:
                return None, None, "several statuses" if status else "no file"
            body = b""
            for f in sorted(files, key=lambda f: f.path):
                with store.open_input_stream(f.path) as stream:
                    body += stream.read()
            return int(status.pop()), body.decode(), None
        except (OSError, UnicodeDecodeError) as e:
            return None, None, str(e)[:200]

    @staticmethod
    def batch(partition: PageRange, rows: list[tuple]) -> pa.RecordBatch:
        page, status, body, error = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([partition.source] * n), pa.array([partition.term] * n), pa.array(page, pa.int32()), pa.array(status, pa.int32()), pa.array(body, pa.string()), pa.array(error, pa.string())], ["source", "term", "page", "status", "body", "error"])


def escaped(name: str) -> str:
    return _ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", name)


def read_pages(spark: SparkSession, path: str, wanted: list[tuple[str, str, int | None]], pages_a_task: int = PAGES_A_TASK) -> DataFrame:
    """PAGE rows of the searches ``wanted`` (source, term, most pages or None for all that landed)."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").options(path=path, wanted=json.dumps([list(w) for w in wanted]), pages_a_task=str(pages_a_task)).load()


@dataclass(frozen=True)
class Envelope:
    """Where an answer has its items, and the mark of the last page."""

    items: str
    last: str


#: The answers' own names. Fixed values.
ENVELOPES = {"platform_a": Envelope("$.data.content", "$.data.last"), "platform_b": Envelope("$.result.positions", "$.result.emptyPosition")}


def _of_source(make) -> Column:
    """``make`` of each source's envelope, by the row's source."""
    out = F.when(F.lit(False), make(next(iter(ENVELOPES.values()))))
    for name, envelope in ENVELOPES.items():
        out = out.when(F.col("source") == name, make(envelope))
    return out


def listed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source, term, page, place, item`` (a variant) of the pages that a walk reads, and ``source, term, n_pages, error`` of each walk.

    A walk takes a term's pages in turn and ends with one that failed (not 200, or no JSON object), is empty, is marked as the last, or isn't
    followed by the next. Pages after that aren't read, items before a failure count.
    """
    v = F.try_parse_json("body")
    rows = pages.withColumn("v", F.when(F.col("error").isNull() & (F.col("status") == 200), v))
    rows = rows.withColumn("items", F.coalesce(_of_source(lambda e: F.try_variant_get("v", e.items, "array<variant>")), F.array().cast("array<variant>")))
    why = F.coalesce("error", F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.when(~F.coalesce(F.to_json("v").startswith("{"), F.lit(False)), F.lit("no JSON object")))
    last = F.coalesce(_of_source(lambda e: F.try_variant_get("v", e.last, "boolean")), F.lit(False))
    told = rows.select("source", "term", "page", why.alias("why"), "items", (why.isNotNull() | last | (F.size("items") == 0)).alias("ends"))
    # a row a term; its pages are as many as the settings allow at most
    walks = told.groupBy("source", "term").agg(F.min(F.when(F.col("ends"), F.col("page"))).alias("end"), F.array_sort(F.collect_set("page")).alias("pages"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("page"))).alias("error"), F.min(F.when(F.col("why").isNotNull(), F.col("page"))).alias("error_at"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(0), F.array_max("pages") + 1), "pages"))
    walks = walks.withColumn("stop", F.least(F.coalesce(F.col("end"), gap - 1), gap - 1))
    failed = F.coalesce(F.col("error_at") <= F.col("stop"), F.lit(False))
    walks = walks.select("source", "term", (F.col("stop") + 1).cast("int").alias("n_pages"), F.when(failed, F.col("error")).when(gap == 0, F.lit(NOT_LANDED)).alias("error"))
    read = told.filter("why is null").join(walks.select("source", "term", "n_pages"), ["source", "term"]).filter("page < n_pages")
    return read.select("source", "term", "page", F.posexplode("items").alias("place", "item")), walks


def searches(settings: dict) -> list[dict]:
    """The enabled sources of the settings with ``type``, ``search`` and, of known ones, ``terms`` and ``most`` pages (``max_pages`` null: None, all that landed). A single ``search`` stands for platform A."""
    given = settings.get("sources")
    enabled = [s for s in given if s.get("enabled", True)] if given else [{"type": "platform_a", "search": settings.get("search") or {}}]
    out = []
    for source in enabled:
        kind = {"platform": "platform_a"}.get(source.get("type", "platform_a"), source.get("type", "platform_a"))
        search = source.get("search")
        search = (settings.get("search") or {}) if search is None and kind == "platform_a" else search or {}
        terms = search.get("keywords") if kind == "platform_a" else search.get("job_categories")
        most = search.get("max_pages", search.get("pages_per_keyword", 8) if kind == "platform_a" else 5)
        out.append({"type": kind, "search": search, "terms": [str(t) for t in terms or [ANY_TERM]], "most": most})
    return out
