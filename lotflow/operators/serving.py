"""What the dashboard asks: live status, recent activity, history and forecast per lot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotflow.domain import KEEP_PER_LOT
from lotflow.functions.numbers import available, fill_pct, judgement, rate_pct
from lotflow.functions.text import date_text, hour_label, time_text


def newest_per_lot(rows: DataFrame, time: str, k: int = KEEP_PER_LOT, *ties: str) -> DataFrame:
    """The newest ``k`` rows of every lot; each task keeps ``k`` per lot before the shuffle."""
    w = W.partitionBy("lot_id").orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties])
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def recent_events(events: DataFrame, k: int = KEEP_PER_LOT) -> DataFrame:
    named = events.select("event_id", "lot_id", F.col("campus").alias("campus_name"), "event_type",
                          F.col("event_ts").alias("event_timestamp"))
    return newest_per_lot(named, "event_timestamp", k, "event_id")


def lots_by_campus(current: DataFrame, campus: str | None = None) -> DataFrame:
    """Live status in lot order with the percentage; one campus, or all lots when none is named."""
    rows = current if campus is None else current.filter(F.col("campus_name") == campus.upper())
    return rows.withColumn("occupancy_rate_pct", rate_pct(F.col("occupancy_rate"))).orderBy("lot_id")


def live_status(current: DataFrame) -> DataFrame:
    """Available spots, fill percentage and status label per lot."""
    pct = fill_pct(F.col("current_occupancy"), F.col("capacity"))
    return current.select(
        "lot_id", available(F.col("current_occupancy"), F.col("capacity")).alias("available"),
        pct.alias("pct"), judgement(pct).alias("judgement"),
    )


def _of_lot(rows: DataFrame, lot: str | None) -> DataFrame:
    """One lot's rows, or all rows when no lot is named."""
    return rows if lot is None else rows.filter(F.col("lot_id") == lot)


def recent_activity(recent: DataFrame, lot: str | None = None, n: int = 10) -> DataFrame:
    """The newest ``n`` events of a lot, or of every lot, with date and time text."""
    newest = newest_per_lot(_of_lot(recent, lot), "event_timestamp", n, "event_id")
    shown = newest.withColumns({"date": date_text(F.col("event_timestamp")), "time": time_text(F.col("event_timestamp")),
                                "event": F.col("event_type")})
    return shown.orderBy("lot_id", F.desc("event_timestamp"), F.desc("event_id"))


def history_for_weekday(history: DataFrame, weekday: str, lot: str | None = None) -> DataFrame:
    """The hours of a weekday for a lot, or for every lot."""
    rows = _of_lot(history, lot).filter(F.col("day_of_week") == weekday)
    return rows.select("lot_id", "hour_of_day", "average_occupancy_lot", "peak_spikes_count").orderBy("lot_id", "hour_of_day")


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    """The newest forecast of every lot."""
    rest = [c for c in forecasts.columns if c not in ("lot_id", "forecast_time")]
    newest = forecasts.groupBy("lot_id").agg(F.max(F.struct("forecast_time", *rest)).alias("f"))
    return newest.select("lot_id", "f.*")


def current_hour_metrics(lots: DataFrame, history: DataFrame, weekday: Column, hour: Column) -> DataFrame:
    """Averages of the given hour for every lot of the dimension, zeros where there is no history."""
    now = history.filter((F.col("day_of_week") == weekday) & (F.col("hour_of_day") == hour)).select(
        "lot_id", F.col("average_occupancy_lot").alias("avg_occ"), F.col("average_duration_minutes").alias("avg_dur"))
    return lots.select("lot_id").join(now, "lot_id", "left").fillna(0.0, subset=["avg_occ", "avg_dur"])


def lot_details(current: DataFrame, history: DataFrame, recent: DataFrame, forecasts: DataFrame,
                weekday: Column, hour: Column) -> DataFrame:
    """One row per lot with the day's hourly chart, recent events, the current hour and the newest forecast.

    Per lot the arrays hold at most 24 hours and the kept recent events.
    """
    today = history.filter(F.col("day_of_week") == weekday)
    chart = today.groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct(
        hour_label(F.col("hour_of_day")).alias("time"), F.col("average_occupancy_lot").alias("pct")))).alias("chart"))
    activity = recent.groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct(
        "event_timestamp", "event_id", "event_type")), asc=False).alias("activity"))
    hours = current_hour_metrics(current, history, weekday, hour)
    newest = latest_forecast(forecasts).select("lot_id", "forecast_time", "predicted_occupancy_count",
                                               "predicted_num_departures", "predicted_occupancy_pct")
    joined = current.select("lot_id", "campus_name", "capacity", "current_occupancy")
    for part in (hours, chart, activity, newest):
        joined = joined.join(part, "lot_id", "left")
    return joined


def due_events(events: DataFrame, as_of: str, n: int = 50) -> DataFrame:
    """The first ``n`` events due by ``as_of``."""
    return events.filter(F.col("event_ts") <= F.lit(as_of).cast("timestamp")).orderBy("event_ts", "event_id").limit(n)


def chronological(events: DataFrame) -> DataFrame:
    return events.orderBy("event_ts", "event_id")
