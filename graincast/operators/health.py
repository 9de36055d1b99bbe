"""Health of sources from the history of fetches; failed and empty stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(fetches: DataFrame) -> DataFrame:
    """State of each ``source_id`` after all its fetches (``at, seq, ok, jobs``).

    One aggregation finds the last success. Failures are held against it by a join whose other side has one row a
    source (broadcast at run time if small, split if a dead source is skewed) and counted before they are shuffled again.
    """
    last = fetches.groupBy("source_id").agg(
        F.max(F.when(F.col("ok"), F.struct("at", "seq", "jobs"))).alias("good"),
        F.max(F.when(F.col("ok") & (F.col("jobs") > 0), F.struct("at", "seq", "jobs"))).alias("full"),
        F.max("at").alias("last_checked"),
        F.count(F.lit(1)).alias("n_fetches"),
    )
    good = last.select(F.col("source_id").alias("sid"), F.col("good.at").alias("good_at"), F.col("good.seq").alias("good_seq"))
    bad = fetches.filter("not ok").join(good, F.col("source_id") == F.col("sid"))
    later = bad.filter(F.col("good_at").isNull() | (F.struct("at", "seq") > F.struct("good_at", "good_seq")))
    counted = last.join(later.groupBy(F.col("sid").alias("source_id")).agg(F.count(F.lit(1)).alias("failures")), "source_id", "left")
    emptied = F.col("good.jobs") == 0
    return counted.select("source_id", "n_fetches", "last_checked", F.col("good.at").alias("last_success"), F.col("good.jobs").alias("jobs_seen"), F.coalesce("failures", F.lit(0)).cast("long").alias("consecutive_failures"), F.when(emptied, F.col("full.jobs")).alias("last_nonzero"), F.when(emptied, F.col("full.at")).alias("last_nonzero_at"))


def warnings(state: DataFrame, least: int = 2) -> DataFrame:
    """Sources that failed ``least`` times on end, or were emptied; by source."""
    kind = F.when(F.col("consecutive_failures") >= least, "failed").when((F.col("jobs_seen") == 0) & F.col("last_nonzero").isNotNull(), "emptied")
    return state.withColumn("warning", kind).filter("warning is not null").orderBy("source_id")


def summary(fetches: DataFrame) -> DataFrame:
    """Counts of one run's fetches; failed and empty sources apart, with their ids (one run fetches a source once)."""
    ids = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("source_id").cast("string")))), ",")
    empty = F.col("ok") & (F.col("jobs") == 0)
    return fetches.agg(F.count(F.lit(1)).alias("checked"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if(empty).alias("n_empty"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("jobs"))), F.lit(0)).alias("n_jobs"), ids(~F.col("ok")).alias("failed_ids"), ids(empty).alias("empty_ids"))
