"""Nightly jobs: clean one day of raw events, then add it to the hourly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.functions.timeparts import previous_local_day
from lotflow.operators.hourly import hourly_metrics, peak_spikes
from lotflow.operators.merge import merge_history
from lotflow.operators.sessions import impute_departures
from lotflow.operators.validate import drop_untimed, parse_lenient, readable_ts
from lotflow.schemas import HISTORY
from lotflow.sources.events import scan_clean_day, scan_day
from lotflow.sources.sinks import write_clean
from lotflow.sources.versions import update


def day_to_process(spark: SparkSession, as_of: str) -> str:
    """The day before ``as_of`` on the local calendar."""
    day = spark.range(1).select(previous_local_day(F.lit(as_of).cast("timestamp")).cast("string").alias("day"))
    return day.first()["day"]


def clean_log(raw: DataFrame) -> DataFrame:
    """Raw text events to a log with exactly one arrival and one departure per arrived session."""
    timed = drop_untimed(parse_lenient(raw))
    if "event_id" not in timed.columns:
        timed = timed.withColumn("event_id", F.xxhash64("session_id", "event_type", "timestamp"))
    return impute_departures(timed)


def untimed(raw: DataFrame) -> DataFrame:
    """The rows that ``clean_log`` can't place in time, with the reason."""
    return raw.filter(readable_ts(F.col("timestamp")).isNull()).withColumn("reason", F.lit("timestamp"))


def run_clean(spark: SparkSession, landed: str, out: str, as_of: str, bad: str | None = None) -> bool:
    """Clean yesterday's events; False when there are none, which is no failure.

    Events without a readable time go to a folder of the day below ``bad`` (by default ``<out>-untimed``).
    """
    day = day_to_process(spark, as_of)
    raw = scan_day(spark, landed, day)
    if raw.isEmpty():
        return False
    untimed(raw).write.mode("overwrite").parquet(f"{bad or out.rstrip('/') + '-untimed'}/date={day}")
    write_clean(clean_log(raw), out)
    return True


def history_rows(clean: DataFrame, capacity: DataFrame) -> DataFrame:
    return peak_spikes(hourly_metrics(clean, capacity))


def stored_history(rows: DataFrame) -> DataFrame:
    """The metric rows in the types of the stored table."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY.fields])


def run_history(spark: SparkSession, clean: str, root: str, capacity: DataFrame, as_of: str) -> bool:
    """Replace yesterday's (lot, weekday, hour) rows in the history table; False when the day has no events."""
    events = scan_clean_day(spark, clean, day_to_process(spark, as_of))
    if events.isEmpty():
        return False
    new = stored_history(history_rows(events, capacity))
    update(spark, root, HISTORY, lambda old: merge_history(old, new))
    return True
