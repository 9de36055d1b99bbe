"""Sharding: weighted rendezvous hashing of stable record keys.

Each shard draws a score for a key from a hash of both; the highest score gets the key. A new shard can
only win keys, never move one between old shards, and a shard of twice the weight wins twice the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincast.llm.common import join_small, materialize, table, unit_hash, unit_hash_sql

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, minus) of the best of shards ``first ..`` for a key; the shard is ``-minus``.

    The score is -weight / ln(u), u uniform from (key, shard); equal scores go to the lower shard.
    Null keys count as the empty string. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    shards = F.array(*[F.struct(F.lit(first + i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    score = lambda s: -s["w"] / F.ln(unit_hash(text, s["i"].cast("string")))
    return F.array_max(F.transform(shards, lambda s: F.struct(score(s).alias("score"), (-s["i"]).alias("minus"))))


def shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add ``out``, the shard of each row by ``key``, and ``grown``, its shard if one more were added."""
    best = df.withColumn("__best", rendezvous(F.col(f"`{key}`"), weights))
    if grown:
        more = rendezvous(F.col(f"`{key}`"), [grown_weight], first=len(weights))
        best = best.withColumn(grown, (-F.greatest(F.col("__best"), more)["minus"]).cast("int"))
    return best.withColumn(out, (-F.col("__best.minus")).cast("int")).drop("__best")


def with_slots(df: DataFrame, key: str, tie: Sequence[str], shard_col: str = "shard", out: str = "slot") -> DataFrame:
    """Add ``out``: a gapless number from 0 within each shard, in the order of md5(key), key, tie columns.

    A shard holds a fixed share of any input, so it is never ranked in one task: rows are ranked within
    (shard, first three hex digits of md5(key)) and start at the count of the shard's earlier parts. Those
    counts, 4096 a shard at most, come from a separate aggregation over keys alone.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = df.withColumn("__md5", F.md5(text))
    rows = rows.withColumn("__part", F.concat_ws("/", F.col(shard_col).cast("string"), F.substring("__md5", 1, 3)))
    counts = rows.groupBy("__part", shard_col).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "shard-starts")
    rank = Window.partitionBy("__part").orderBy("__md5", F.col(f"`{key}`"), *tie)
    ranked = rows.withColumn("__rank", F.row_number().over(rank))
    placed = join_small(ranked, starts, "__part", F.col("__rank"))
    return placed.withColumn(out, (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__md5", "__part", "__rank", "__start")


def op1_rendezvous_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``key``.

    A null text has size 8 and CRC 0. A null doc_id is the empty key. Repeated rows share a shard and get
    slots of their own. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = shard(sized, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    slots = with_slots(placed, "doc_id", ["size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_SCORE = f"-1.0 / ln({unit_hash_sql("coalesce(d.doc_id::VARCHAR, '') || '#' || s.i::VARCHAR")})"



def _crc_tables(n: int) -> list[list[int]]:
    """CRC-32 tables for n bytes at a time, by the rule of its polynomial."""
    first = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        first.append(c)
    tables = [first]
    for _ in range(n - 1):
        tables.append([c >> 8 ^ first[c & 255] for c in tables[-1]])
    return tables


def _crc_sql(hexes: str) -> str:
    """DuckDB has no CRC-32: fold it over eight bytes a step, then over the rest byte by byte."""
    tables = _crc_tables(8)
    byte = lambda at: f"('0x' || substr({hexes}, 2 * ({at}) + 1, 2))::BIGINT"
    look = lambda k, x: f"{tables[k]}[(({x}) & 255) + 1]"
    low = " + ".join(f"({byte(f'8 * j + {i}')} << {8 * i})" for i in range(4))
    high = " + ".join(f"({byte(f'8 * j + {4 + i}')} << {8 * i})" for i in range(4))
    step = "xor(" * 7 + look(7, "xor(c, w.lo)")
    for i in range(1, 8):
        step += ", " + look(7 - i, f"xor(c, w.lo) >> {8 * i}" if i < 4 else f"w.hi >> {8 * (i - 4)}") + ")"
    fold = f"list_reduce(list_transform(range(0, length({hexes}) // 16), lambda j: {{'lo': {low}, 'hi': {high}}}), lambda c, w: {step}, 4294967295::BIGINT)"
    rest = f"list_transform(range(length({hexes}) // 16 * 8, length({hexes}) // 2), lambda j: {byte('j')})"
    return f"xor(4294967295, list_reduce({rest}, lambda c, b: xor(c >> 8, {look(0, 'xor(c, b)')}), {fold}))"


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    hex(encode(coalesce(text, ''))) AS h FROM documents
), crcs AS (
  SELECT rid, doc_id, size::BIGINT AS size, {_crc_sql("h")} AS text_crc32 FROM sized
), scores AS (
  SELECT d.rid, s.i, {_SCORE} AS score FROM crcs d CROSS JOIN range({SHARDS + 1}) AS s(i)
), best AS (
  SELECT rid, (arg_max(i, (score, -i)) FILTER (i < {SHARDS}))::INTEGER AS shard, arg_max(i, (score, -i))::INTEGER AS grown_shard
  FROM scores GROUP BY rid
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM crcs JOIN best USING (rid)
"""
