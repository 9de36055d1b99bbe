"""Landed payloads: embedded career pages, rich-text bodies, state snapshots. Fetching itself stays outside."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graincast.functions.scan import best_object, decode

POSITION = "struct<workspaceField:struct<field:string>,workspaceOccupation:struct<occupation:string>,workspacePlace:struct<location:string,place:string,workFromHome:boolean>,jobPositionCareer:struct<careerFrom:int,careerTo:int>,jobPositionEmployment:struct<employmentType:string>>"
OPENING = f"struct<openingId:bigint,title:string,openDate:string,dueDate:string,openingJobPosition:struct<openingJobPositions:array<{POSITION}>>>"
PAGE = f"struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<queryKey:array<string>,state:struct<data:string>>>>>>>"


def openings(html: Column) -> Column:
    """struct(error, items) of a career page: the embedded JSON's query whose key is ["openings"]."""
    raw = F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    page = F.from_json(raw, PAGE)
    queries = page["props"]["pageProps"]["dehydratedState"]["queries"]
    mine = F.get(F.filter(queries, lambda q: (F.size(q["queryKey"]) == 1) & (q["queryKey"][0] == "openings")), F.lit(0))
    items = F.from_json(mine["state"]["data"], f"array<{OPENING}>")
    error = F.when(raw == "", "no embedded data").when(queries.isNull(), "broken data").when(mine.isNull(), "no openings query").when(items.isNull(), "openings aren't a list")
    return F.struct(error.alias("error"), items.alias("items"))


def fold_positions(items: DataFrame) -> DataFrame:
    """Adds regions, fields and the widest career range of each opening, without exploding its positions."""
    pos = F.col("item.openingJobPosition.openingJobPositions")
    pick = lambda f: F.array_distinct(F.filter(F.transform(pos, f), lambda x: F.coalesce(x, F.lit("")) != ""))
    return items.withColumns({
        "fields": pick(lambda p: p["workspaceField"]["field"]), "occupations": pick(lambda p: p["workspaceOccupation"]["occupation"]), "regions": pick(lambda p: F.coalesce(F.nullif(p["workspacePlace"]["location"], F.lit("")), p["workspacePlace"]["place"])),
        "employee_types": pick(lambda p: p["jobPositionEmployment"]["employmentType"]), "career_min": F.array_min(F.transform(pos, lambda p: p["jobPositionCareer"]["careerFrom"])), "career_max": F.array_max(F.transform(pos, lambda p: p["jobPositionCareer"]["careerTo"])),
    })


def flatten_text(node: object) -> str:
    """Text leaves of a recursive {type, text, content} tree, depth first."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            if x.get("type") == "text" and isinstance(x.get("text"), str) and x["text"]:
                out.append(x["text"])
            todo.append(x.get("content") or [])
    return " ".join(out)


def _texts(found: list[str | None]) -> pa.Array:
    """Texts for Arrow; halves of surrogate pairs, which JSON can spell, become question marks."""
    return pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in found], pa.string())


@F.arrow_udf(T.StringType())
def rich_text(body: pa.Array) -> pa.Array:
    """Text of a rich-text body given as JSON of any depth; null if it isn't JSON."""

    def one(s: str | None) -> str | None:
        try:
            return flatten_text(decode(s)) if s is not None else None
        except ValueError:
            return None

    return _texts([one(s) for s in body.to_pylist()])


@F.arrow_udf(T.StringType())
def embedded_json(text: pa.Array) -> pa.Array:
    """The best JSON object in a text as it stands there, see ``best_object``; null without any."""
    return _texts([best_object(s) if s else None for s in text.to_pylist()])


def detail_text(own: Column, tree_text: Column, keywords: Column) -> Column:
    """A source's own text, else the rich text and a line of tags."""
    tags = F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n[태그] "), F.array_join(keywords, ", ")))
    made = F.regexp_replace(F.concat(F.coalesce(tree_text, F.lit("")), F.coalesce(tags, F.lit(""))), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(own, F.lit("")), made)
