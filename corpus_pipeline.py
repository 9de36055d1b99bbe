"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE. Each stage reads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincast.llm import bpe, langid, mixing, neardup, site_lines
from graincast.llm.common import ROW, drop_path, materialize, materialize_at, n_words, numbered, table


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; those without a letter, without text or unlike every language go.

    Rows are judged one by one, so null and repeated ids stay as they are, and own columns may have any name.
    """
    prototypes = langid.learn(docs)
    made = ("__graincast_lang", "__graincast_score", "__graincast_known")
    told = langid.predict(docs, prototypes, made=made, keep_text=True)
    return told.filter(made[2]).select(*[F.col(f"`{n}`") for n in docs.columns])


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` follows the text. No row goes."""
    counts = ("__graincast_n_lines", "__graincast_n_dropped")
    out = site_lines.drop_site_lines(docs, "source", counts=counts)
    out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{n}`") for n in docs.columns])


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the first row of its smallest id.

    Rows are told apart by their place in the files, so rows of null or repeated ids stay or go by their own texts.
    """
    rows = numbered(docs)
    gone = neardup.near_duplicates(rows, ROW).filter("not first").select(*[F.col(c).alias(f"{c}_gone") for c in ROW])
    gone = materialize(gone, "gone")
    same = [F.col(c) == F.col(f"{c}_gone") for c in ROW]
    return rows.join(gone, same, "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's rate and its draw say, copies as rows.

    Rows of one id draw alike, also those of null ids.
    """
    return mixing.emit(mixing.mix(docs, docs.select("source", n_words(F.col("text")).alias("size")), "doc_id")).select(*[F.col(f"`{n}`") for n in docs.columns])


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return bpe.encode(docs.select("doc_id", "source", "lang", "text")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_dedup), ("mixing", mix), ("BPE", encode)]

#: Language ID and BPE aren't SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each result is written and read again, and goes when the next one stands.

    An empty table gives no rows; whole texts are read however long they are. See the stages for other odd rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize_at(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if before:
            drop_path(spark, before)  # its reader is done
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
