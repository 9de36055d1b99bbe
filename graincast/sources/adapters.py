"""Sources: landed rows of each to postings and details. Fetching stays outside; what it returns is a table.

A source is an object with ``name``, ``raw(items)`` (what a page lists, as variants), ``postings(raw)`` and ``details(raw)``; ``SOURCES`` finds it by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING = ("id", "seq", "source", "title", "company", "canonical", "depth_ones", "depth_twos", "synthetic", "regions", "employee_types", "career_min", "career_max", "created", "deadline", "detail_url")
#: What a rolling deadline is called, work from home, kinds of employment, section names, provinces.
ROLLING, HOME = "상시", "재택"
EMPLOYMENT = {"FULL_TIME_WORKER": "정규직", "CONTRACT_WORKER": "계약직", "INTERN": "인턴", "PART_TIME_WORKER": "파트타임"}
SECTIONS = ("responsibility", "qualifications", "preferredRequirements", "welfares")
PROVINCES = (
    "서울특별시", "서울", "부산광역시", "부산", "대구광역시", "대구", "인천광역시", "인천", "광주광역시", "광주", "대전광역시", "대전", "울산광역시", "울산", "세종특별자치시", "세종", "경기도", "경기", "강원특별자치도", "강원",
    "충청북도", "충북", "충청남도", "충남", "전북특별자치도", "전라북도", "전북", "전라남도", "전남", "경상북도", "경북", "경상남도", "경남", "제주특별자치도", "제주",
)
#: Robots rules of career pages: single openings' forms, mobile and admin pages, below the languages too. Fixed values.
DISALLOW, LANGUAGES = ("/o/*/apply", "/m/", "/a/"), ("ko", "en")
FORBIDDEN = f"^(/({'|'.join(LANGUAGES)}))?({'|'.join(rule.replace('*', '[^/]+') for rule in DISALLOW)})"


def query_string(filters: dict[str, object]) -> str:
    """A source's own filter: values of one key are alternatives, keys must all hold, empty ones are left out."""
    pairs = [(k, x) for k, v in filters.items() if v for x in (v if isinstance(v, list | tuple) else [v])]
    return "&".join(f"{k}={quote(str(x))}" for k, x in pairs)


def forbidden(url: Column) -> Column:
    """Whether a page must not be fetched, by its path."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[^:/]*://)?[^/]*(/[^?#]*)?", 1), "^$", "/")
    return path.rlike(FORBIDDEN)


def rolling_or_day(value: Column, rolling: Column) -> Column:
    return F.when(F.coalesce(rolling, F.lit(False)), ROLLING).otherwise(F.nullif(F.substring(value, 1, 10), F.lit("")))


def region(place: Column, location: Column) -> Column:
    """Province and the word after it of an address; else the location's name, else the address."""
    address = F.trim(F.coalesce(place, F.lit("")))
    found = rf"({'|'.join(PROVINCES)})(?:\s*(\S+))?"
    named = F.trim(F.concat_ws(" ", F.regexp_extract(address, found, 1), F.regexp_extract(address, found, 2)))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.trim(location), F.lit("")), address)


def last_by_id(rows: DataFrame, key: str = "id", at: str = "seq") -> DataFrame:
    """One row an id from pages fetched in turn: the last one's values at the first one's place. One aggregation."""
    rest = [c for c in rows.columns if c not in (key, at)]
    found = rows.groupBy(key).agg(F.min(at).alias(at), F.max_by(F.struct(*rest), at).alias("last"))
    return found.select(key, at, "last.*")


def said(path: str, kind: str = "string") -> Column:
    """A part of the variant ``item``, null if it isn't there or of another kind."""
    return F.try_variant_get("item", path, kind)


def texts(path: str) -> Column:
    return F.filter(F.coalesce(said(path, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


class PlatformA:
    """Rows come as postings already; a page may list an id again."""

    name = "platform_a"

    def raw(self, items: DataFrame) -> DataFrame:
        """From ``seq, item``."""
        shown = lambda path: F.coalesce(F.nullif(said(path), F.lit("")), F.lit("?"))
        return items.select(
            said("$.id").alias("id"), "seq", shown("$.title").alias("title"), shown("$.company.name").alias("company"), F.lit("").alias("canonical"), texts("$.depthOnes").alias("depth_ones"), texts("$.depthTwos").alias("depth_twos"),
            texts("$.regions").alias("regions"), texts("$.employeeTypes").alias("employee_types"), said("$.careerMin", "int").alias("career_min"), said("$.careerMax", "int").alias("career_max"), F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("deadline"),
        ).filter("id is not null")

    def postings(self, raw: DataFrame) -> DataFrame:
        return last_by_id(raw.withColumn("id", F.col("id").cast("string"))).withColumns({"source": F.lit(self.name), "synthetic": F.lit(False), "detail_url": F.lit(None).cast("string")})

    def details(self, raw: DataFrame) -> DataFrame:
        return raw.select(F.col("id").cast("string").alias("id"), "created", "body", F.col("redirect").alias("url"))


@dataclass
class PlatformB:
    """Raw: id, seq, title, companyName, minCareer, maxCareer, locations, closedAt, alwaysOpen. ``depth_twos`` are the roles asked for, so they are made up."""

    roles: Sequence[str] = ()
    site: str = ""
    name = "platform_b"

    def raw(self, items: DataFrame) -> DataFrame:
        """From ``seq, item``."""
        return items.select(
            said("$.id").alias("id"), "seq", said("$.title").alias("title"), said("$.companyName").alias("companyName"), said("$.minCareer", "int").alias("minCareer"), said("$.maxCareer", "int").alias("maxCareer"), texts("$.locations").alias("locations"),
            said("$.closedAt").alias("closedAt"), F.coalesce(said("$.alwaysOpen", "boolean"), F.lit(False)).alias("alwaysOpen"),
        ).filter("id is not null")

    def page(self) -> Column:
        return F.concat(F.lit(f"{self.site}/position/"), F.col("id")) if self.site else F.lit(None).cast("string")

    def postings(self, raw: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
        rows = last_by_id(raw.withColumn("id", F.col("id").cast("string")))
        return rows.select(
            "id", "seq", F.lit(self.name).alias("source"), shown("title").alias("title"), shown("companyName").alias("company"), F.lit("").alias("canonical"), none.alias("depth_ones"),
            F.array(*[F.lit(r) for r in self.roles]).cast("array<string>").alias("depth_twos"), F.lit(True).alias("synthetic"), F.coalesce("locations", none).alias("regions"), none.alias("employee_types"),
            F.col("minCareer").alias("career_min"), F.col("maxCareer").alias("career_max"), F.lit(None).cast("string").alias("created"), rolling_or_day(F.col("closedAt"), F.col("alwaysOpen")).alias("deadline"), self.page().alias("detail_url"),
        )

    def details(self, raw: DataFrame) -> DataFrame:
        """Raw: id, publishedAt, the sections, techStacks (names). Sections with a head each, empty ones left out, a blank line between."""
        parts = [F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(f"[{s}]\n"), F.col(s))) for s in SECTIONS]
        stacks = F.filter(F.coalesce("techStacks", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
        tech = F.when(F.size(stacks) > 0, F.concat(F.lit("[기술스택] "), F.array_join(stacks, ", ")))
        body = F.trim(F.concat_ws("\n\n", *parts, tech))
        return raw.withColumn("id", F.col("id").cast("string")).select("id", F.col("publishedAt").alias("created"), body.alias("body"), self.page().alias("url"))


class CareerPages:
    """Companies' own pages. Raw: company_id, company, careers_url, family, seq, item (an opening, see ``landed``)."""

    name = "official"

    def postings(self, raw: DataFrame) -> DataFrame:
        pos = F.coalesce(F.col("item.openingJobPosition.openingJobPositions"), F.array())
        each = lambda f: F.array_distinct(F.filter(F.transform(pos, f), lambda x: F.coalesce(x, F.lit("")) != ""))
        place = lambda p: F.array(region(p["workspacePlace"]["place"], p["workspacePlace"]["location"]), F.when(p["workspacePlace"]["workFromHome"], HOME))
        regions = F.array_distinct(F.filter(F.flatten(F.transform(pos, place)), lambda x: F.coalesce(x, F.lit("")) != ""))
        kinds = F.create_map(*[F.lit(x) for pair in EMPLOYMENT.items() for x in pair])
        kind = lambda p: F.coalesce(F.try_element_at(kinds, F.coalesce(p["jobPositionEmployment"]["employmentType"], F.lit(""))), p["jobPositionEmployment"]["employmentType"])
        base = F.regexp_replace(F.split("careers_url", "/ko/|/en/")[0], "/+$", "")
        number = F.col("item.openingId").cast("string")
        rows = raw.filter("item.openingId is not null")
        return rows.select(
            F.concat_ws(":", "family", "company_id", number).alias("id"), "seq", F.col("family").alias("source"), F.coalesce(F.nullif(F.col("item.title"), F.lit("")), F.lit("?")).alias("title"), "company", F.col("company_id").alias("canonical"),
            each(lambda p: p["workspaceField"]["field"]).alias("depth_ones"), each(lambda p: p["workspaceOccupation"]["occupation"]).alias("depth_twos"), F.lit(False).alias("synthetic"), regions.alias("regions"), each(kind).alias("employee_types"),
            F.array_min(F.transform(pos, lambda p: p["jobPositionCareer"]["careerFrom"])).alias("career_min"), F.array_max(F.transform(pos, lambda p: p["jobPositionCareer"]["careerTo"])).alias("career_max"), F.col("item.openDate").alias("created"),
            rolling_or_day(F.col("item.dueDate"), F.coalesce(F.col("item.dueDate"), F.lit("")) == "").alias("deadline"), F.concat(base, F.lit("/ko/o/"), number).alias("detail_url"),
        )

    def details(self, raw: DataFrame) -> DataFrame:
        """No request: the list has it all."""
        return self.postings(raw).select("id", "created", F.lit("").alias("body"), F.col("detail_url").alias("url"))


SOURCES: dict[str, Callable[[], object]] = {"platform_a": PlatformA, "platform_b": PlatformB, "official": CareerPages}


__all__ = ["CareerPages", "PlatformA", "PlatformB", "SOURCES", "forbidden", "last_by_id", "query_string", "region", "rolling_or_day"]
