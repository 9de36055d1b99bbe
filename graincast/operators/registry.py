"""Watch-list of companies: resolution of names, role filters, and reports on the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.functions.text import contains_any, role_text
from graincast.session import small_side

TIERS = ("S", "A", "B", "C")
#: What is known about collecting from a company. Fixed values.
STATUSES = ("generic_adapter_priority", "adapter_candidate", "dynamic_research_needed", "restricted_research_needed", "group_portal_research_needed", "job_endpoint_research_needed")
COLLECTIBLE = STATUSES[:2]


class RegistryError(ValueError):
    """The watch-list is wrong; the message says where."""


def keys(companies: DataFrame) -> DataFrame:
    """``key, company_id, enabled`` of names and aliases."""
    spread = companies.select(F.col("id").alias("company_id"), "enabled", F.explode(F.array_distinct(F.concat(F.array("name_key"), "alias_keys"))).alias("key"))
    return spread.filter("key <> ''")


def collisions(companies: DataFrame) -> DataFrame:
    """Keys that several companies claim, disabled ones too."""
    return keys(companies).groupBy("key").agg(F.countDistinct("company_id").alias("n")).filter("n > 1")


def checked(companies: DataFrame) -> DataFrame:
    """``companies``; raises if two share an id or a key."""
    twice = companies.groupBy("id").count().filter("count > 1").limit(3).collect()
    if twice:
        raise RegistryError("repeated ids: " + ", ".join(r["id"] for r in twice))
    shared = collisions(companies).orderBy("key").limit(3).collect()
    if shared:
        raise RegistryError("keys of several companies: " + ", ".join(r["key"] for r in shared))
    return companies


def resolve(postings: DataFrame, companies: DataFrame, key: str, enabled_only: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """``postings`` with ``target_id`` and the company's columns ``carry``, null if unknown; a posting stays one row also if keys collide.

    The list is broadcast only if its values are few bytes.
    """
    known = keys(companies.filter("enabled") if enabled_only else companies).groupBy(F.col("key").alias("__key")).agg(F.min("company_id").alias("target_id"))
    if carry:
        known = known.join(companies.select(F.col("id").alias("target_id"), *carry), "target_id")
    return postings.join(small_side(known), postings[key] == F.col("__key"), "left").drop("__key")


def role_hay(synthetic: Column | None = None, unicode: bool = True) -> Column:
    """What roles are looked for in: title and depths; the title alone if a source made the depths up."""
    depths = F.array_join(F.concat(F.array(F.lit("")), "depth_twos", "depth_ones"), " ")
    if synthetic is not None:
        depths = F.when(synthetic, F.lit("")).otherwise(depths)
    return role_text(F.concat(F.coalesce("title", F.lit("")), depths), unicode)


def role_allowed(hay: Column, include: str, exclude: str) -> Column:
    """An excluded part forbids; no included parts allow all."""
    has = lambda c: F.exists(c, lambda x: hay.contains(x))
    return ~has(exclude) & ((F.size(include) == 0) | has(include))


def qualify(resolved: DataFrame, title_exclude: list[str], unicode: bool = True) -> DataFrame:
    """Adds ``reason``: not_target, role or null, from ``target_id`` and the company's ``roles_include`` and ``roles_exclude``.

    A company's roles decide, its own or the list's; without any, the excluded title words do. No score counts.
    """
    synthetic = F.col("synthetic") if "synthetic" in resolved.columns else None
    roles = (F.size(F.coalesce("roles_include", F.array())) > 0) | (F.size(F.coalesce("roles_exclude", F.array())) > 0)
    plain = ~contains_any(F.lower("title"), [t.lower() for t in title_exclude])
    # only rows of the list need the hay; Python, which folds it, can't stand within a lambda
    seen = resolved.withColumn("__hay", F.when(F.col("target_id").isNotNull(), role_hay(synthetic, unicode)))
    allowed = F.when(roles, role_allowed(F.col("__hay"), "roles_include", "roles_exclude")).otherwise(plain)
    return seen.withColumn("reason", F.when(F.col("target_id").isNull(), "not_target").when(~F.coalesce(allowed, F.lit(False)), "role")).drop("__hay")


def key_typos(companies: DataFrame) -> DataFrame:
    """Companies with fields nobody knows."""
    return companies.filter(F.size("unknown_keys") > 0).select("id", F.array_join("unknown_keys", ",").alias("unknown"))


def unclassified(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("enabled") & F.col("status").isNull()).select("id")


def official_urls(companies: DataFrame) -> DataFrame:
    """``id, urls``: the careers page and the official sources' pages, each once, in order; ``types`` of all sources."""
    own = F.filter(F.col("sources"), lambda s: (s["type"] == "official") & (F.coalesce(s["url"], F.lit("")) != ""))
    page = F.filter(F.array("careers_url"), lambda u: F.coalesce(u, F.lit("")) != "")
    return companies.select("id", F.array_distinct(F.concat(page, F.transform(own, lambda s: s["url"]))).alias("urls"), F.transform("sources", lambda s: s["type"]).alias("types"))


def adapted(companies: DataFrame, adapters: list[str]) -> DataFrame:
    """Enabled collectible companies whose family has an adapter."""
    return companies.filter(F.col("enabled") & F.col("status").isin(*COLLECTIBLE) & F.coalesce("family", "id").isin(*adapters))


def near_misses(names: DataFrame, known: DataFrame) -> DataFrame:
    """``raw, key``: names not on the list that a key begins or ends, or that begin or end a key, two letters or more apart.

    A key that is the shorter one is one of the name's own prefixes or suffixes, and the other way round, so both
    directions are equi-joins on exploded affixes instead of a nested loop.
    """
    fresh = names.select("raw").distinct().join(known.select(F.col("key").alias("raw")).distinct(), "raw", "left_anti").filter(F.length("raw") >= 2)
    own = known.select("key").distinct().filter(F.length("key") >= 2)

    def affixes(df: DataFrame, c: str) -> DataFrame:
        long = df.filter(F.length(c) >= 4)
        cut = F.sequence(F.lit(2), F.length(c) - 2)
        both = F.array_distinct(F.concat(F.transform(cut, lambda n: F.substring(F.col(c), F.lit(1), n)), F.transform(cut, lambda n: F.substring(F.col(c), F.length(c) - n + 1, n))))
        return long.select(c, F.explode(both).alias("affix"))

    longer = affixes(fresh, "raw").join(own, F.col("affix") == F.col("key")).select("raw", "key")
    shorter = affixes(own, "key").join(fresh, F.col("affix") == F.col("raw")).select("raw", "key")
    return longer.union(shorter).distinct()


def families(companies: DataFrame) -> DataFrame:
    return companies.filter("enabled").groupBy(F.coalesce("family", "id").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def collectible(companies: DataFrame) -> DataFrame:
    """Families to write adapters for, those of most companies first."""
    return families(companies.filter(F.col("status").isin(*COLLECTIBLE))).orderBy(F.desc("n"), "family")


def portal_conflicts(companies: DataFrame) -> DataFrame:
    """Portals that two enabled companies share while one of them has no filter: those without."""
    shared = companies.filter(F.col("enabled") & (F.coalesce("careers_url", F.lit("")) != "")).groupBy("careers_url").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("has_filter"), F.col("id")))), ",").alias("lacking"))
    return shared.filter("n >= 2 and lacking <> ''")


def research_needed(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("enabled") & F.col("status").isNotNull() & ~F.col("status").isin(*COLLECTIBLE)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tier_listing(companies: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).cast("int")
    return companies.filter("enabled").select(rank.alias("tier_rank"), "tier", F.coalesce("priority", F.lit(0)).alias("priority"), "id").orderBy("tier_rank", F.desc("priority"), "id")
