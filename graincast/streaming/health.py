"""Streaming facades: arrivals deduplicated and health counted as fetches come in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def first_arrivals(postings: DataFrame, key: str, at: str = "at", delay: str = "1 day") -> DataFrame:
    """One row a key within the watermark; state is dropped behind it."""
    return postings.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def hourly_health(fetches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fetches, failures and empty successes of each source in each hour; late rows count until the watermark."""
    return fetches.withWatermark("at", delay).groupBy(F.window("at", "1 hour"), "source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & (F.col("jobs") == 0)).alias("empty"))


#: Times are microseconds within the processor.
HEALTH = "source_id string, n_fetches long, last_checked long, last_success long, jobs_seen long, consecutive_failures long, last_nonzero long, last_nonzero_at long"
_TOTALS = "n long, checked long, good_at long, good_seq long, good_jobs long, full_at long, full_seq long, full_jobs long, settled long"


class HealthProcessor(StatefulProcessor):
    """A source's health, kept as its fetches come in, in any order within the watermark.

    Failures after the last success are listed while a late success may still come between them; those that the watermark has passed
    are settled: they are only counted until the next success. So a source that is dead for good holds a number, not a history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)
        self.failures = handle.getListState("failures", "at long, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, checked, good_at, good_seq, good_jobs, full_at, full_seq, full_jobs, settled = self.totals.get() if self.totals.exists() else (0, None, None, None, None, None, None, None, 0)
        open_ones = [(at, seq) for at, seq in self.failures.get()]
        for row in rows:
            n += 1
            checked = row["us"] if checked is None else max(checked, row["us"])
            place = row["us"], row["seq"]
            if not row["ok"]:
                open_ones.append(place)
                continue
            if good_at is None or place > (good_at, good_seq):
                good_at, good_seq, good_jobs = *place, row["jobs"]
                settled = 0  # what the watermark had passed is before any success that comes now
            if (row["jobs"] or 0) > 0 and (full_at is None or place > (full_at, full_seq)):
                full_at, full_seq, full_jobs = *place, row["jobs"]
        open_ones = [p for p in open_ones if good_at is None or p > (good_at, good_seq)]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [p for p in open_ones if p[0] >= passed]
        settled += len(open_ones) - len(held)
        self.failures.put(held) if held else self.failures.clear()
        self.totals.update((n, checked, good_at, good_seq, good_jobs, full_at, full_seq, full_jobs, settled))
        emptied = good_jobs == 0
        yield Row(source_id=key[0], n_fetches=n, last_checked=checked, last_success=good_at, jobs_seen=good_jobs, consecutive_failures=settled + len(held), last_nonzero=full_jobs if emptied else None, last_nonzero_at=full_at if emptied else None)

    def close(self) -> None:
        pass


def health_updates(fetches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The health of each ``source_id`` (text) whenever fetches (``at, seq, ok, jobs``) of it come in; ``operators.health.rollup`` says the same of the whole history.

    Needs a state store with several states a key: ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB one.
    """
    rows = fetches.select("source_id", "at", F.unix_micros("at").alias("us"), "seq", "ok", F.col("jobs").cast("long").alias("jobs")).withWatermark("at", delay)
    told = rows.groupBy("source_id").transformWithState(HealthProcessor(), HEALTH, "Update", "EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("last_checked", "last_success", "last_nonzero_at")})
