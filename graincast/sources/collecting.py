"""A collection: what the enabled sources and the companies' own pages gave, as one table of postings and a result of each source."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincast.session import written
from graincast.sources import adapters, careers, pages

RESULT = "nth int, source string, ok boolean, error string, n_walks int, n_pages long, jobs long"
SOURCE_RESULT = ("nth", "source", "ok", "error", "n_walks", "n_pages", "jobs")


@dataclass
class Collected:
    """``postings`` before repost dedup, ``sources`` (a row each) and ``companies`` (a row each, None if their pages weren't asked for)."""

    postings: DataFrame
    sources: DataFrame
    companies: DataFrame | None = None


def arrival(term: str, page: str, place: str):
    """Order of arrival within a source: terms as they were asked for, pages, places. For up to 4,096 terms and a million pages and places."""
    return (F.col(term).cast("long") * (1 << 40)) + (F.col(page).cast("long") * (1 << 20)) + F.col(place)


#: The place of the companies' own pages: after all sources.
OFFICIAL_NTH = 1 << 9


def over_all(nth: str):
    """``seq`` within a source to the order over all of them."""
    return F.col(nth).cast("long") * (1 << 52) + F.col("seq")


def from_pages(spark: SparkSession, path: str, settings: dict) -> Collected:
    """The postings of all enabled sources' landed pages, in one read.

    A source failed if a walk of its terms failed and it gave nothing at all; one nobody knows failed as such. Others aren't touched.
    """
    asked = pages.searches(settings)
    known = [(nth, s) for nth, s in enumerate(asked) if s["type"] in adapters.SOURCES and s["type"] in pages.ENVELOPES]
    unknown = [(nth, s["type"], False, "unknown source", 0, 0, 0) for nth, s in enumerate(asked) if all(nth != n for n, _ in known)]
    results = spark.createDataFrame(unknown, RESULT)
    roles = tuple((settings.get("filter") or {}).get("primary_depth_twos") or ())
    site = os.environ.get("PLATFORM_B_SITE_BASE", "").rstrip("/")
    if not known:
        return Collected(empty(spark), results)
    terms = [(nth, s["type"], t, i) for nth, s in known for i, t in enumerate(s["terms"])]
    order = F.broadcast(spark.createDataFrame(terms, "nth int, source string, term string, term_nth int"))  # as many as the settings name
    landed = pages.read_pages(spark, path, [(s["type"], t, s["most"]) for _, s in known for t in s["terms"]])
    items, walks = pages.listed(written(landed, "pages"))  # walks and items read it
    items = items.join(order, ["source", "term"]).withColumn("seq", arrival("term_nth", "page", "place"))
    parts = []
    for nth, search in known:
        source = adapters.PlatformB(roles, site) if search["type"] == "platform_b" else adapters.SOURCES[search["type"]]()
        mine = items.filter((F.col("nth") == nth) & (F.col("source") == search["type"]))
        parts.append(source.postings(source.raw(mine.select("seq", "item"))).select(*adapters.POSTING, F.lit(nth).alias("nth")).withColumn("seq", over_all("nth")))
    postings = united(parts)
    per = walks.join(order, ["source", "term"]).groupBy("nth", "source").agg(F.count(F.lit(1)).cast("int").alias("n_walks"), F.sum("n_pages").alias("n_pages"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("term_nth"))).alias("error"))
    per = per.join(postings.groupBy("nth").agg(F.count(F.lit(1)).alias("jobs")), "nth", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    ok = F.col("error").isNull() | (F.col("jobs") > 0)
    return Collected(postings, results.unionByName(per.withColumn("ok", ok).withColumn("error", F.when(~ok, F.col("error"))).select(*SOURCE_RESULT)))


def empty(spark: SparkSession) -> DataFrame:
    strings, arrays, numbers = ("id", "source", "title", "company", "canonical", "created", "deadline", "detail_url"), ("depth_ones", "depth_twos", "regions", "employee_types"), ("career_min", "career_max")
    kinds = {**dict.fromkeys(strings, "string"), **dict.fromkeys(arrays, "array<string>"), **dict.fromkeys(numbers, "int"), "seq": "long", "synthetic": "boolean"}
    return spark.createDataFrame([], ", ".join([*(f"{c} {kinds[c]}" for c in adapters.POSTING), "nth int"]))


def united(parts: list[DataFrame]) -> DataFrame:
    """The bag union of sources in turn."""
    return reduce(DataFrame.unionByName, parts)


def with_official(spark: SparkSession, got: Collected, companies: DataFrame, landed_pages: DataFrame) -> Collected:
    """``got`` and the postings of the companies' own pages, after those of all sources."""
    rows = careers.fetched(companies, landed_pages)
    own = careers.postings(rows, companies).select(*adapters.POSTING, F.lit(OFFICIAL_NTH).alias("nth")).withColumn("seq", over_all("nth"))
    return Collected(united([got.postings, own]), got.sources, careers.results(rows))
