"""Mixing sources to target weights: repetition rates from aggregated sizes, hash-seeded Bernoulli copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincast.llm.common import join_small, materialize, n_words, table, unit_hash, unit_hash_sql

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, size`` -> ``source, source_size, weight, target``; one row a source.

    Sources in code-point order, null last, take ``weights`` in turn. Targets share ``share`` times all
    sizes by weight, none above ``most`` times its own size; what is above goes to the others by weight.
    That water level is found in closed form: with sources in order of cap / weight, the first k are
    full and the rest take level * weight. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # one row a source in these global windows, never one a document
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("size").cast("double") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    full = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    leveled = ranked.select(
        "*",
        (F.lit(share) * F.sum("size").over(whole)).alias("goal"),
        F.coalesce(F.sum("cap").over(full), F.lit(0.0)).alias("full_caps"),
        F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest_weight"),
    ).withColumn("level", (F.col("goal") - F.col("full_caps")) / F.col("rest_weight"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    leveled = leveled.withColumn("water", F.max(fits).over(whole))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return leveled.select("source", F.col("size").alias("source_size"), "weight", target.alias("target"))


def mix(docs: DataFrame, sized: DataFrame, key: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Add ``__graincast_copies``, ``__graincast_source_size`` and ``__graincast_target`` to ``docs``, which have ``source`` and ``key``.

    copies = floor(rate) + 1 if u < rate - floor(rate), where rate = target / source_size and u is a hash of
    (seed, key). Sizes come from ``sized`` (source, size), rows without texts, in one aggregation; the rates, a row a
    source, are joined to ``docs`` without a shuffle unless there are too many sources. Sources without words get rate 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets(sums, weights, share, most).select(F.col("source").alias("__graincast_source"), F.col("source_size").alias("__graincast_source_size"), F.col("target").alias("__graincast_target"), rate.alias("__graincast_rate"))
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rated = join_small(docs.withColumn("__graincast_source", F.col("source")), materialize(rates, "mix-rates"), "__graincast_source", text)
    whole = F.floor("__graincast_rate")
    copies = (whole + (unit_hash(F.lit(seed), text) < F.col("__graincast_rate") - whole).cast("int")).cast("int")
    return rated.withColumn("__graincast_copies", F.coalesce(copies, F.lit(0))).drop("__graincast_source", "__graincast_rate")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, without the columns of ``mix``."""
    turns = F.explode(F.sequence(F.lit(1), F.col("__graincast_copies")))
    return mixed.filter("__graincast_copies > 0").withColumn("__graincast_copy", turns).drop("__graincast_copy", "__graincast_copies", "__graincast_source_size", "__graincast_target")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words each document gives, repeats counted.

    A null text has size 0, a null source is a source of its own, repeated rows draw alike, and an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    copies = F.col("__graincast_copies")
    return mix(sized, sized, "doc_id").select("doc_id", "size", F.col("__graincast_source_size").alias("source_size"), F.col("__graincast_target").alias("target"), (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "source")


_U = unit_hash_sql(f"'{SEED}#' || coalesce(doc_id::VARCHAR, '')")


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sums
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), watered AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM leveled),
goals AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM watered
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goals),
drawn AS (
  SELECT doc_id, size, source_size, target, (floor(rate) + ({_U} < rate - floor(rate))::INT)::INTEGER AS copies, d.source
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM drawn
"""
