"""Hourly history per lot and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotflow.domain import PEAK_SHARE
from lotflow.functions.numbers import is_peak
from lotflow.functions.timeparts import weekday_name
from lotflow.operators.occupancy import with_delta
from lotflow.operators.sessions import attach_duration


def hourly_metrics(events: DataFrame, capacity: DataFrame) -> DataFrame:
    """Mean stay, mean and highest running count and the capacity per lot, weekday and hour.

    ``date`` is the session's arrival date, ``event_ts`` the event's own time.  Means are over event rows: a session
    counts in the hour it came and in the hour it left, and events of one instant share the running count.

    Events are summed per instant first (combined before the shuffle), so an instant with very many events is one
    row.  A second of a lot then has at most 10^6 rows, whose running counts are summed up as (rows, net change,
    sum of counts, highest count); these add up over the earlier seconds of the day without touching events again.
    """
    instants = (
        with_delta(attach_duration(events))
        .groupBy("lot_id", "date", "event_ts")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("delta").alias("net"),
            F.sum("duration_seconds").alias("stay"), F.count("duration_seconds").alias("stays"),
        )
    )
    in_second = W.partitionBy("lot_id", "date", "_slice").orderBy("event_ts").rowsBetween(W.unboundedPreceding, 0)
    seconds = (
        instants.withColumn("_slice", F.date_trunc("second", "event_ts"))
        .withColumn("inside", F.sum("net").over(in_second))
        .groupBy("lot_id", "date", "_slice")
        .agg(
            F.sum("n").alias("n"), F.sum("net").alias("net"), F.sum(F.col("n") * F.col("inside")).alias("area"),
            F.max("inside").alias("top"), F.sum("stay").alias("stay"), F.sum("stays").alias("stays"),
        )
    )
    earlier = W.partitionBy("lot_id", "date").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    placed = seconds.withColumn("before", F.coalesce(F.sum("net").over(earlier), F.lit(0)))
    hours = placed.groupBy(
        "lot_id", weekday_name(F.col("date")).alias("day_of_week"), F.hour("_slice").alias("hour_of_day")
    ).agg(
        F.sum("n").alias("n"), F.sum(F.col("area") + F.col("before") * F.col("n")).alias("area"),
        F.max(F.col("before") + F.col("top")).alias("max_occupancy_hourly"),
        F.sum("stay").alias("stay"), F.sum("stays").alias("stays"),
    )
    dim = capacity.select("lot_id", F.col("capacity").alias("lot_capacity"))
    return hours.join(dim, "lot_id", "left").select(
        "lot_id", "day_of_week", "hour_of_day",
        (F.try_divide(F.col("stay").cast("double"), F.col("stays").cast("double")) / F.lit(60.0)).alias("average_duration_minutes"),
        (F.col("area").cast("double") / F.col("n").cast("double")).alias("average_occupancy_lot"),
        "max_occupancy_hourly", "lot_capacity",
    )


def peak_spikes(hours: DataFrame, share: float = PEAK_SHARE) -> DataFrame:
    """The stored metric rows: averages and a 0/1 flag for hours whose highest count reached ``share`` of capacity."""
    return hours.select(
        "lot_id", "day_of_week", "hour_of_day", "average_occupancy_lot", "average_duration_minutes",
        is_peak(F.col("max_occupancy_hourly"), F.col("lot_capacity"), share).alias("peak_spikes_count"),
    )


def history_rollup(hours: DataFrame) -> DataFrame:
    """Over all weekdays, per lot and hour: the mean of their average counts, as a count and as a share of capacity.

    A lot has at most seven rows per hour.
    """
    mean = F.avg("average_occupancy_lot")
    pct = F.try_divide(mean * F.lit(100.0), F.max("lot_capacity").cast("double"))
    return hours.groupBy("lot_id", "hour_of_day").agg(
        F.count(F.lit(1)).alias("weekdays"), mean.alias("average_occupancy_lot"), pct.alias("average_occupancy_pct"))
