"""Line dedup by site-relative frequency: lines on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import join_small, materialize, table

#: A line goes if it stands on more than this share of its site's pages ...
MAX_RATIO = 0.1
#: ... and on this many pages at least, so that small sites keep what two copies of a page share.
MIN_PAGES = 10

_BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; the empty string if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def boilerplate(docs: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, lines``: for each site the 64-bit hashes of its boilerplate lines.

    A page counts a line once. Lines compare trimmed; blank lines never count. (site, line) pairs are counted
    with map-side sums, so neither a hot site nor a hot line meets in one task. A site has at most
    lines per page / max_ratio such lines, which bounds the gathered array.
    """
    pages = docs.select(F.col(f"`{site}`").alias("__graincast_site"), F.col(f"`{text}`").alias("__text"))
    totals = pages.groupBy("__graincast_site").agg(F.count(F.lit(1)).alias("__pages"))
    hashes = F.expr(f"array_distinct(transform(filter(split(__text, '\\n'), l -> {_trim('l')} <> ''), l -> xxhash64({_trim('l')})))")
    counts = pages.select("__graincast_site", F.explode(hashes).alias("__line")).groupBy("__graincast_site", "__line").agg(F.count(F.lit(1)).alias("__on"))
    often = counts.filter(F.col("__on") >= min_pages)
    both = often.join(totals.withColumnRenamed("__graincast_site", "__t_site"), F.col("__graincast_site").eqNullSafe(F.col("__t_site")))
    bad = both.filter(F.col("__on") > F.lit(max_ratio) * F.col("__pages"))
    return bad.groupBy("__graincast_site").agg(F.collect_list("__line").alias("__graincast_lines"))


def _trim(x: str) -> str:
    return f"trim(BOTH '{_BLANKS}' FROM {x})"


def drop_site_lines(docs: DataFrame, site: str, text: str = "text", key: str = "doc_id", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` rid of its site's boilerplate lines; the columns ``counts`` are added.

    Other lines keep their bytes and order. Null texts stay null with 0 lines; a text of only boilerplate
    becomes empty. The first count is of lines that are not blank, the second of dropped ones. ``key`` only spreads rows over tasks.
    """
    bad = materialize(boilerplate(docs, site, text, max_ratio, min_pages), "site-lines")
    wide = docs.withColumn("__graincast_site", F.col(f"`{site}`"))
    joined = join_small(wide, bad, "__graincast_site", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    t = f"`{text}`"
    lines = f"filter(split({t}, '\\n'), l -> {_trim('l')} <> '')"
    keep = f"filter(split({t}, '\\n'), l -> {_trim('l')} = '' or not array_contains(__graincast_lines, xxhash64({_trim('l')})))"
    dropped = f"size(filter({lines}, l -> array_contains(__graincast_lines, xxhash64({_trim('l')}))))"
    out = joined.withColumn(counts[0], F.expr(f"case when {t} is null then 0 else size({lines}) end"))
    out = out.withColumn(counts[1], F.expr(f"case when {t} is null or __graincast_lines is null then 0 else {dropped} end"))
    return out.withColumn(text, F.expr(f"case when `{counts[1]}` = 0 then {t} else array_join({keep}, '\\n') end")).drop("__graincast_site", "__graincast_lines")


def op10_site_lines(spark, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source, which stands for the site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_site_lines(docs, "source").select("doc_id", "source", "n_lines", "n_dropped", "text")


def _duck_trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"


OP10_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
lines AS (
  SELECT rid, source, u.pos, u.line, {_duck_trim("u.line")} AS bare
  FROM pages, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), bad AS (
  SELECT l.source, l.bare FROM (SELECT source, bare, count(DISTINCT rid) AS n FROM lines WHERE bare <> '' GROUP BY source, bare) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n >= {MIN_PAGES} AND l.n > {MAX_RATIO}::DOUBLE * t.n
), marked AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare),
joined AS (
  SELECT rid, count(*) FILTER (bare <> '')::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_dropped,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY rid
)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL WHEN coalesce(n_dropped, 0) = 0 THEN text ELSE coalesce(kept, '') END AS text
FROM pages LEFT JOIN joined USING (rid)
"""
