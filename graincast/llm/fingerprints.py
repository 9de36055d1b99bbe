"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

One 64-bit hash for each distinct five-word shingle: its low 8 bits choose one of 256 bins, its upper 48 bits
compete for the minimum there. An empty bin takes the minimum of the first full bin in its own pseudo-random
order of all bins, the same order for every text. Four low-order bits of each bin are kept, as one hex digit,
so a fingerprint is 256 hex digits. Two unrelated minima agree in those bits once in 16; likeness corrects
for that: (matches / 256 - 1/16) / (1 - 1/16), not below 0.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincast.llm.common import BROADCAST_BYTES, let, materialize, table, value_bytes, words

BINS = 256
BITS = 4
SHINGLE = 5
#: Rows that one window task ranks, about.
ROWS_PER_BUCKET = 1024
#: Quantile cuts that even out clustered ids.
CUTS = 128

_VALUE = (1 << 48) - 1


#: An empty bin asks (start + step * attempt) mod 256 in turn; the attempts are tried in these lazy spans.
SPANS = ((0, 3), (4, 15), (16, 63), (64, BINS - 1))


def probes(seed: int = 7) -> tuple[list[int], list[int]]:
    """For each bin the start and the odd step of its order of all bins."""
    draw = random.Random(seed)
    return [draw.randrange(BINS) for _ in range(BINS)], [2 * draw.randrange(BINS // 2) + 1 for _ in range(BINS)]


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; null and texts without words give 256 zeros.

    A text of fewer than five words is one shingle. Words are split at ASCII white space and compared as they are.
    """
    none = F.lit(_VALUE)
    bin_of = lambda x: F.shiftright(x, 48)
    # a sentinel above every hash gives each bin an entry; after sorting, a bin's first entry is its minimum
    sentinels = F.array(*[F.lit((b << 48) | _VALUE) for b in range(BINS)])
    start, step = (F.array(*[F.lit(x) for x in xs]) for xs in probes())

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[h[i + j] for j in range(SHINGLE)]))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def key(x: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(BINS - 1)), 48).bitwiseOR(F.shiftrightunsigned(x, 16))

    def minima(s: Column) -> Column:
        ordered = F.sort_array(F.concat(F.transform(s, key), sentinels))
        return let(ordered, lambda k: F.filter(k, lambda x, i: (i == 0) | (bin_of(k[F.greatest(i - 1, F.lit(0))]) != bin_of(x))))

    def dense(m: Column) -> Column:
        asked = lambda i, j: m[(start[i] + step[i] * j).bitwiseAND(F.lit(BINS - 1))]
        first = lambda i, a, b: F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda j: asked(i, j)), lambda y: y.bitwiseAND(none) != none), F.lit(0))
        donor = lambda i: F.coalesce(*[first(i, a, b) for a, b in SPANS])
        return F.transform(m, lambda x, i: F.when(x.bitwiseAND(none) == none, donor(i)).otherwise(x))

    # hashed with the bin, or the copies of a lone shingle's minimum would agree with another's all at once
    digit = lambda x, i: F.substring(F.lit("0123456789abcdef"), F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1))
    packed = lambda s: let(minima(s), lambda m: F.array_join(F.transform(dense(m), digit), ""))
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) == 0, F.lit("0" * BINS)).otherwise(let(shingles(h), packed)))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two fingerprint columns, 0 to 1; empty texts are like each other only."""
    longs = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.conv(F.substring(F.col(c), j * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    # a hex digit differs if any of its four bits does
    ones = F.lit(0x1111111111111111)
    smear = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    differ = F.aggregate(F.zip_with(longs(a), longs(b), lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda n, x: n + F.bit_count(smear(x).bitwiseAND(ones)))
    chance = 1.0 / (1 << BITS)
    zeros = F.lit("0" * BINS)
    estimate = F.greatest(F.lit(0.0), ((BINS - differ) / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == zeros) | (F.col(b) == zeros), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, order: str, text: str, out: str, add: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``out``, which is ``add(text)``, and with ``next_<text>`` and ``next_<out>`` of the next row.

    Rows follow each other by ``order`` (null first), then ``text``; after the last comes the first. No task sees
    more than about ROWS_PER_BUCKET neighbours: ids are cut at quantiles and again in equal steps, the next row
    is found within a bucket, and the head of the next bucket follows a bucket's last row. Heads are one row a
    bucket, ranked within a quantile, then one row a quantile. Each text is shuffled and given to ``add`` once.
    """
    o = F.coalesce(F.col(order), F.lit(-(1 << 63)))
    stats = docs.select(o.alias("o")).agg(F.count("o").alias("n"), F.percentile_approx("o", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("q")).first()
    n, cuts = stats["n"] or 0, sorted(set(stats["q"] or [0]))
    per_cut = max(1, -(-n // (CUTS * ROWS_PER_BUCKET)))
    # few rows: several quantiles share a bucket
    share = max(1, CUTS * ROWS_PER_BUCKET // max(1, n)) if per_cut == 1 else 1
    low = F.array(*[F.lit(float(c)) for c in cuts])
    wide = F.array(*[F.lit(max(1.0, (float(b) - float(a)) / per_cut)) for a, b in zip(cuts, cuts[1:] + cuts[-1:], strict=True)])

    def placed(rows: DataFrame) -> DataFrame:
        cut = F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__o"))) - 1)
        rows = rows.withColumn("__o", o).withColumn("__q", cut)
        step = F.floor((F.col("__o").cast("double") - low[F.col("__q")]) / wide[F.col("__q")]) if per_cut > 1 else F.lit(0)
        return rows.withColumn("__step", step.cast("long")).withColumn("__cut", F.floor(F.col("__q") / share).cast("int")).drop("__q")

    bucket = ["__cut", "__step"]
    first = materialize(placed(docs.select(order)).groupBy(*bucket).agg(F.min("__o").alias("__head")), "head-ids")
    found = first.select("__head") if value_bytes(first) > BROADCAST_BYTES else F.broadcast(first.select("__head"))
    at_head = placed(docs.select(order, text)).join(found, F.col("__o") == F.col("__head"), "left_semi")
    heads = materialize(at_head.groupBy(*bucket).agg(F.min(text).alias(f"next_{text}")).withColumn(f"next_{out}", add(F.col(f"next_{text}"))), "heads")

    in_cut = Window.partitionBy("__cut").orderBy("__step")
    keyed = first.select(*bucket, F.lead("__step").over(in_cut).alias("__to_step"), F.row_number().over(in_cut).alias("__nth"))
    starts = keyed.filter("__nth = 1").select(*bucket)  # a row a quantile
    by_cut, whole = Window.orderBy("__cut"), Window.partitionBy()
    next_cut = starts.select("__cut", F.coalesce(F.lead("__cut").over(by_cut), F.min("__cut").over(whole)).alias("__next_cut"))
    hop = keyed.join(next_cut, "__cut").join(starts.select(F.col("__cut").alias("__next_cut"), F.col("__step").alias("__next_step")), "__next_cut")
    within_cut = F.col("__to_step").isNotNull()
    hop = hop.select(*bucket, F.when(within_cut, F.col("__cut")).otherwise(F.col("__next_cut")).alias("__to_cut"), F.coalesce("__to_step", "__next_step").alias("__to_step"))
    follow = heads.select(F.col("__cut").alias("__to_cut"), F.col("__step").alias("__to_step"), F.col(f"next_{text}").alias(text), F.col(f"next_{out}").alias(out))
    ghosts = hop.join(follow, ["__to_cut", "__to_step"]).select(*bucket, text, out, F.lit(True).alias("__ghost"))

    # the head of the next bucket stands behind a bucket's rows, so one shuffle and one window serve all rows
    rows = placed(docs.withColumn(out, add(F.col(text)))).withColumn("__ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    within = Window.partitionBy(*bucket).orderBy("__ghost", "__o", text)
    leads = [F.lead(c).over(within).alias(f"next_{c}") for c in (text, out)]
    return rows.select("*", *leads).filter("not __ghost").drop("__o", "__ghost", *bucket)


def op7_oph_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Null texts count as empty. Rows of one doc_id follow each other in the order of their texts; a null
    doc_id comes first. A single row is its own next document. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, "doc_id", "text", "fingerprint", fingerprint)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    pairs = pairs.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
