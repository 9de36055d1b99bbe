"""Companies' own career pages: a table function that takes a company's landed pages and gives its openings or why there are none."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graincast.functions.scan import decode
from graincast.operators import registry
from graincast.sources import adapters, landed

#: Families of career sites that are read, and the version of the reading.
FAMILIES, PARSER_VERSION = ("greetinghr",), 1
#: Where a page of that family keeps its data. Fixed values.
EMBEDDED = re.compile(r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', re.S)
OPENINGS = ["openings"]
FETCHED = "company_id string, family string, ok boolean, error string, http_status int, final_url string, nth int, item string"


class PageError(ValueError):
    """A page that isn't as it should be."""


def field(value: object, *names: str) -> object:
    """A field of a field, None where there is none."""
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def openings_of(html: str) -> list:
    """The openings embedded in a page."""
    found = EMBEDDED.search(html)
    if not found:
        raise PageError("no embedded data")
    try:
        page = decode(found.group(1))
    except ValueError:
        raise PageError("broken data") from None
    queries = field(page, "props", "pageProps", "dehydratedState", "queries")
    for query in queries if isinstance(queries, list) else []:
        if field(query, "queryKey") == OPENINGS:
            data = field(query, "state", "data")
            if not isinstance(data, list):
                raise PageError("openings aren't a list")
            return data
    raise PageError("no openings query")


@F.udtf(returnType=FETCHED)
class CareerOpenings:
    """For TABLE(...) PARTITION BY company_id ORDER BY at: a row an opening of the company's last page, or one row without an opening.

    That row has ``ok`` with an empty page and ``error`` with one that failed. Whatever a page holds, other companies aren't touched.
    """

    def __init__(self):
        self.last: Row | None = None

    def eval(self, row: Row) -> None:
        self.last = row

    def terminate(self) -> Iterator[tuple]:
        page = self.last
        if page is None:
            return
        head = (page["company_id"], page["family"])
        try:
            items = [json.dumps(x, ensure_ascii=False).encode("utf-8", "replace").decode() for x in self.items(page) if field(x, "openingId") is not None]
        except (PageError, RecursionError) as e:
            yield (*head, False, str(e)[:200], page["status"], page["final_url"], None, None)
            return
        for nth, item in enumerate(items):
            yield (*head, True, None, page["status"], page["final_url"], nth, item)
        if not items:
            yield (*head, True, None, page["status"], page["final_url"], None, None)

    @staticmethod
    def items(page: Row) -> list:
        if page["refused"]:
            raise PageError(page["refused"])
        if page["status"] is not None and page["status"] != 200:
            raise PageError(f"HTTP {page['status']}")
        if page["html"] is None:
            raise PageError(page["failure"] or "no page landed")
        return openings_of(page["html"])


def fetched(companies: DataFrame, landed_pages: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """FETCHED rows of the enabled companies that can be collected and whose family is read.

    ``landed_pages`` has company_id, at, status, final_url, html and failure. A company without an address, with one that must
    not be fetched, or without a page gets its failure too. A company's pages meet in one call; companies are dealt over the tasks.
    """
    own = registry.adapted(companies, list(families)).select(F.col("id").alias("company_id"), F.coalesce("family", "id").alias("family"), "careers_url")
    refused = F.when(F.coalesce("careers_url", F.lit("")) == "", "no careers_url").when(adapters.forbidden(F.col("careers_url")), "robots rules forbid the address")
    asked = own.withColumn("refused", refused).join(landed_pages, "company_id", "left")
    asked = asked.select("company_id", "family", "refused", "at", "status", "final_url", F.when(F.col("refused").isNull(), F.col("html")).alias("html"), "failure")
    return CareerOpenings(asked.asTable().partitionBy("company_id").orderBy("at"))


def postings(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """The postings of FETCHED rows."""
    item = F.from_json("item", landed.OPENING)
    raw = rows.filter("item is not null").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "careers_url"), "company_id")
    return adapters.CareerPages().postings(raw.select("company_id", "company", "careers_url", "family", F.col("nth").cast("long").alias("seq"), item.alias("item")))


def results(rows: DataFrame) -> DataFrame:
    """A row a company: ``source_id, company_id, family, ok, error, http_status, final_url, jobs``; empty and failed stay apart."""
    by = rows.groupBy("company_id", "family").agg(F.min("ok").alias("ok"), F.min("error").alias("error"), F.min("http_status").alias("http_status"), F.min("final_url").alias("final_url"), F.count("item").alias("jobs"))
    return by.select(F.concat_ws(":", "family", "company_id").alias("source_id"), "company_id", "family", "ok", "error", "http_status", "final_url", F.when(F.col("ok"), F.col("jobs")).alias("jobs"))
