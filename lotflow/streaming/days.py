"""Counts that restart every day, closed at midnight by a timer, whether an event comes or not.

The first stream folds a micro-batch to one triple per lot and day, which is all that the second one reads: it keeps one number
per lot and day as state and moves it on.  Its timers close a day when any lot's events have passed midnight, so a lot
without events stands at 0 the next day and every day after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotflow.operators.occupancy import day_runs
from lotflow.sources.events import read_or_empty
from lotflow.sources.versions import exists
from lotflow.streaming.jobs import _batch_folder, _start, _trigger, state_on_disk

DAY_MS = 86_400_000
#: One batch's triple of a lot and day (days since 1970), with the batch's newest event and its place among the batches.
RUNS = "lot_id string, day int, s bigint, lo bigint, hi bigint, seen timestamp, at timestamp, batch bigint"
#: A lot's count of a day; of several rows the one with the highest ``n`` holds.
DAYS_OUT = "lot_id string, day int, occupancy bigint, closed boolean, n bigint"


class DayCounts(StatefulProcessor):
    """A lot's counts by day.  A group has one row per day and batch, however many events these had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "occupancy bigint")
        self.sent = handle.getValueState("sent", "n bigint")

    def _rows(self, lot, counts: dict[int, int], mark: int) -> pd.DataFrame:
        first = self.sent.get()[0] + 1 if self.sent.exists() else 0
        self.sent.update((first + len(counts) - 1,))
        days = list(counts)
        return pd.DataFrame({"lot_id": lot, "day": days, "occupancy": list(counts.values()),
                             "closed": [(d + 1) * DAY_MS <= mark for d in days], "n": range(first, first + len(days))})

    def _hold(self, day: int, count: int, mark: int) -> None:
        self.days.updateValue((day,), (count,))
        if (day + 1) * DAY_MS > mark:
            self.handle.registerTimer((day + 1) * DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, counts = timerValues.getCurrentWatermarkInMs(), {}
        for run in pd.concat(list(rows)).sort_values(["at", "batch"]).itertuples():
            day = int(run.day)
            if day not in counts:
                counts[day] = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            counts[day] = int(max(run.lo, min(run.hi, counts[day] + run.s)))
        for day, count in counts.items():
            self._hold(day, count, mark)
        yield self._rows(key[0], counts, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closing = expiredTimerInfo.getExpiryTimeInMs()
        mark, day = max(timerValues.getCurrentWatermarkInMs(), closing), closing // DAY_MS - 1
        counts = {day: self.days.getValue((day,))[0]}
        # The days after it start empty, up to the one that the watermark is in or that has events of its own.
        while (day + 1) * DAY_MS <= mark and not self.days.containsKey((day + 1,)):
            day += 1
            counts[day] = 0
            self._hold(day, 0, mark)
        yield self._rows(key[0], counts, mark)

    def close(self) -> None:
        pass


def fold_days(events: DataFrame, capacity: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Every micro-batch as triples per lot and day in a folder of its own below ``<root>/runs``, written once."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        folder = _batch_folder(batch.sparkSession, f"{root}/runs", checkpoint, batch_id)
        if exists(batch.sparkSession, f"{folder}/_SUCCESS"):
            return
        rows = batch.persist()
        try:
            newest = rows.agg(F.max("event_ts").alias("seen")).select("seen").scalar()
            runs = day_runs(rows, capacity).filter(F.col("date").isNotNull()).select(
                "lot_id", F.unix_date("date").alias("day"), "s", "lo", "hi", newest.alias("seen"),
                F.current_timestamp().alias("at"), F.lit(batch_id).cast("bigint").alias("batch"))
            runs.repartition(1).write.mode("overwrite").parquet(folder)
        finally:
            rows.unpersist()

    return _start(events, on_batch, checkpoint, every)


def close_days(spark: SparkSession, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts per lot and day from the folded batches to ``<root>/days``; the clock is the newest event of all lots.

    A late event changes its day, closed or not: its triple carries its batch's time only for the clock, not as its own.
    """
    runs = spark.readStream.schema(RUNS).option("recursiveFileLookup", "true").parquet(f"{root}/runs")
    timed = runs.withWatermark("seen", "0 seconds").select("lot_id", "day", "s", "lo", "hi", "at", "batch")
    with state_on_disk(spark):
        days = timed.groupBy("lot_id").transformWithStateInPandas(DayCounts(), DAYS_OUT, "append", "EventTime")
        return (days.repartition(1).writeStream.format("parquet").option("path", f"{root}/days")
                .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def read_days(spark: SparkSession, root: str) -> DataFrame:
    """The count of every lot and day, and whether the day is over."""
    rows = read_or_empty(spark, f"{root}/days", T.StructType.fromDDL(DAYS_OUT))
    last = F.max_by(F.struct("occupancy", "closed"), "n").alias("last")
    return rows.groupBy("lot_id", "day").agg(last).select(
        "lot_id", F.date_from_unix_date("day").alias("date"), "last.occupancy", "last.closed")
