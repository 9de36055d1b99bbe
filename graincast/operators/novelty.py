"""Runs against state: what is new, fresh and within budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.functions.text import contains_any, iso_date, trim


BROADCAST_IDS = 100_000


def upsert(seen: DataFrame, listed: DataFrame, as_of: str) -> DataFrame:
    """The state after a run: known ids keep first_seen, new ones get the run's date."""
    old = seen.select("id", F.col("first_seen").alias("was"), F.col("notified").alias("told"))
    merged = old.join(listed.select("id", F.lit(True).alias("listed")), "id", "full_outer")
    return merged.select("id", F.coalesce("was", F.when(F.col("listed"), F.lit(as_of))).alias("first_seen"), F.coalesce("told", F.lit(False)).alias("notified"))


def retain(seen: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows first seen within the window; rows without first_seen stay."""
    return seen.filter(F.coalesce("first_seen", F.lit("9999")) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("string"))


def age_days(created: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), iso_date(created))


def fresh(listed: DataFrame, as_of: str, window: int, created: str = "created") -> DataFrame:
    """Rows at most ``window`` days old; those dated ahead pass, those without a date don't."""
    return listed.withColumn("age", age_days(F.col(created), as_of)).filter(F.col("age") <= window)


def budgeted(scored: DataFrame, k: int, score: str = "rule") -> DataFrame:
    """Adds ``in_budget``: the k best by score, then seq. The k ids come from a top-k, not from a global window; only a few are broadcast."""
    best = scored.orderBy(F.desc(score), "seq").limit(k).select(F.col("id").alias("__best"))
    return scored.join(F.broadcast(best) if k <= BROADCAST_IDS else best, F.col("id") == F.col("__best"), "left").withColumn("in_budget", F.col("__best").isNotNull()).drop("__best")


#: Words of a deadline that rolls, and of one nobody knows. Fixed values.
ROLLING = ("상시", "채용시", "채용 시", "수시", "충원")
UNKNOWN_DUE = ("미상", "unknown")


def deadline_state(c: str, as_of: str, rolling: tuple[str, ...] = ROLLING) -> tuple[Column, Column, Column]:
    """label, days left and state of a deadline: ``unknown``, ``rolling`` or ``date``. What is no date is its own label."""
    text, due = trim(F.coalesce(F.col(c), F.lit(""))), iso_date(trim(F.col(c)))
    none = text.isin("", *UNKNOWN_DUE)
    roll = ~none & contains_any(text, list(rolling))
    dated = ~none & ~roll & due.isNotNull()
    days = F.when(dated, F.datediff(due, F.lit(as_of).cast("date")))
    day = F.date_format(due, "MM/dd")
    label = F.when(none, "미상").when(roll, "상시").when(~dated, text).when(days < 0, F.concat(F.lit("마감("), day, F.lit(")")))
    label = label.when(days == 0, F.concat(F.lit("오늘마감("), day, F.lit(")"))).otherwise(F.concat(F.lit("D-"), days.cast("string"), F.lit(" ("), day, F.lit(")")))
    return label, days, F.when(roll, "rolling").when(dated, "date").otherwise("unknown")
