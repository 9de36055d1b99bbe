"""Repost dedup: one row an exact key, first arrival's identity, later rows fill what it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.functions.text import exact_title, loose_title, plain_company


def company_part() -> Column:
    return F.coalesce(F.nullif(F.col("canonical"), F.lit("")), plain_company(F.col("company")))


def loose_key() -> Column:
    return F.concat_ws("|", company_part(), loose_title(F.col("title")))


def exact_key() -> Column:
    bound = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat_ws("|", company_part(), exact_title(F.col("title")), F.concat(bound("career_min"), F.lit("~"), bound("career_max")), F.array_join(F.array_sort("regions"), ","))


def survivors(postings: DataFrame) -> DataFrame:
    """``id, seq`` of each key's first arrival, ``sources`` in order of arrival, ``deadline`` and ``created`` first filled.

    One hash aggregation; ordered picks are minima of (seq, value), so partial results combine before the shuffle.
    Sources are few, so the set of (first seq, source) stays small.
    """
    by_source = postings.withColumn("key", exact_key()).groupBy("key", "source").agg(
        F.min(F.struct("seq", "id")).alias("first"),
        F.min(F.when(F.coalesce("deadline", F.lit("")) != "", F.struct("seq", "deadline"))).alias("due"),
        F.min(F.when(F.coalesce("created", F.lit("")) != "", F.struct("seq", "created"))).alias("made"),
        F.count(F.lit(1)).alias("n"),
    )
    return by_source.groupBy("key").agg(
        F.min("first")["id"].alias("id"), F.min("first")["seq"].alias("seq"), F.min("due")["deadline"].alias("deadline"), F.min("made")["created"].alias("created"),
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col("first.seq").alias("s"), "source")))["source"], ",").alias("sources"), F.sum("n").alias("merged"),
    )


#: What a first arrival takes from later ones if it has none (empty texts and zeros are none). Fixed values.
FILLED = ("deadline", "detail_url", "created", "career_min", "career_max")


def merged(postings: DataFrame, order: tuple[str, ...] = ("seq", "id")) -> DataFrame:
    """The whole rows of each exact key's first arrival, filled from later ones in turn, with ``sources`` in order of arrival and ``n_merged``.

    Rows combine by key and source before they are shuffled, so that a posting that is posted without end doesn't meet in one task
    row by row. A loose key that isn't ambiguous has one exact key, so no other merge is left to do across sources.
    """
    place = F.struct(*order)
    has = {c: F.col(c) != 0 if c.startswith("career") else F.col(c) != "" for c in FILLED if c in postings.columns}
    rows = postings.withColumns({"__key": exact_key(), "__at": place})
    whole = F.struct(*[F.col(f"`{c}`") for c in postings.columns])
    first = lambda c: F.min_by(F.struct(c), F.when(has[c], F.col("__at"))).alias(f"__{c}")
    by_source = rows.groupBy("__key", "source").agg(F.min_by(whole, "__at").alias("__row"), F.min("__at").alias("__at"), F.count(F.lit(1)).alias("__n"), *[first(c) for c in has], *[F.min(F.when(has[c], F.col("__at"))).alias(f"__{c}_at") for c in has])
    by_key = by_source.groupBy("__key").agg(
        F.min_by("__row", "__at").alias("__row"), F.sum("__n").alias("n_merged"), F.array_sort(F.collect_list(F.struct("__at", "source")))["source"].alias("sources"), *[F.min_by(f"__{c}", f"__{c}_at").alias(f"__{c}") for c in has],
    )
    fill = [F.coalesce(F.when(has_in_row(c), F.col(f"__row.{c}")), F.col(f"__{c}.{c}"), F.col(f"__row.{c}")).alias(c) if c in has else F.col(f"__row.`{c}`").alias(c) for c in postings.columns]
    return by_key.select(*fill, "sources", "n_merged")


def has_in_row(c: str) -> Column:
    own = F.col(f"__row.{c}")
    return own != 0 if c.startswith("career") else own != ""


def ambiguous(postings: DataFrame) -> DataFrame:
    """Loose keys that stand for several exact keys."""
    return postings.select(loose_key().alias("loose"), exact_key().alias("exact")).groupBy("loose").agg(F.countDistinct("exact").alias("n_exact")).filter("n_exact > 1")
