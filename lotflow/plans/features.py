"""Training features: what a lot looked like in every 15-minute window, and what came next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.domain import HOLIDAYS, as_dates
from lotflow.functions.timeparts import day_of_week, hour_of_day, in_days, is_weekend, shift
from lotflow.operators.calendar import backfill_flags, calendar_of
from lotflow.operators.grid import dense_grid
from lotflow.operators.occupancy import window_state
from lotflow.operators.ordered import join_nulls
from lotflow.operators.validate import drop_untimed
from lotflow.sources.events import LANDED, read_or_empty, scan_historical, union_sources, unify_historical, unify_realtime
from lotflow.session import shared_dir
from lotflow.sources.sinks import write_training_set

FEATURE_TABLE = ["lot_id", "campus", "timestamp", "occupancy_now", "day_of_week", "hour_of_day", "is_holiday",
                 "is_weekend", "is_exam_week", "occupancy_plus_15m", "departures_in_15m"]


def unified_log(historical: DataFrame, live: DataFrame) -> DataFrame:
    """Both logs in one layout; live events take their flags from the historical calendar."""
    return _joined_logs(unify_historical(historical), live)


def _joined_logs(history: DataFrame, live: DataFrame) -> DataFrame:
    filled = backfill_flags(unify_realtime(live), calendar_of(history))
    return drop_untimed(union_sources(history, filled))


def stored_log(spark: SparkSession, historical: str, landed: str, days: list[str] | None = None) -> DataFrame:
    """The unified log of the converted export and the landed live events; of the given days alone, only their folders are read."""
    logs = scan_historical(spark, historical), read_or_empty(spark, landed, LANDED)
    return _joined_logs(*(logs if days is None else (log.filter(F.col("date").isin(as_dates(days))) for log in logs)))


def run_features(spark: SparkSession, historical: str, landed: str, out: str, holidays: list[str] = HOLIDAYS) -> None:
    """From the stored logs to the stored feature table."""
    cells = window_state(stored_log(spark, historical, landed))
    path = shared_dir(spark, "cells")
    cells.write.parquet(path)
    # The log is read once for the windows (and the history once for its calendar).
    write_training_set(features_of(spark.read.schema(cells.schema).parquet(path), holidays), out)


def run_features_of_days(spark: SparkSession, historical: str, landed: str, store: str, days: list[str],
                         holidays: list[str] = HOLIDAYS) -> bool:
    """Bring the stored features up to date after ``days`` (such as last night's) got new events; False when they have none.

    ``<store>/cells`` keeps the windows' states and ``<store>/features`` the feature table, both by date.  Of the log only the
    given days are read, and their cells replaced.  Features are written anew from the last earlier date with events on, whose
    last windows get their labels and the gap after them now; what came before is carried over from the cells.  Running it
    again for the same days changes nothing, and any order of days ends in the table that ``run_features`` gives.
    """
    path, out = f"{store}/cells", f"{store}/features"
    new = window_state(stored_log(spark, historical, landed, days)).withColumn("date", F.to_date("window_start"))
    _write_dates(new, path)
    cells = read_or_empty(spark, path, new.schema)
    if cells.isEmpty():
        return False
    earlier = cells.filter(F.col("date") < F.lit(min(days)).cast("date")).agg(F.max("date").alias("date")).first()["date"]
    rows = features_from(cells, str(earlier or min(days)), holidays)
    _write_dates(rows.withColumn("date", F.to_date("timestamp")), out)
    return True


def _write_dates(rows: DataFrame, path: str) -> None:
    """Replace the dates at hand, a file each."""
    (rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def features_from(cells: DataFrame, start: str, holidays: list[str] = HOLIDAYS) -> DataFrame:
    """The feature rows from date ``start`` on; all rows if a lot has its first window since, as it gets rows from the beginning."""
    first = F.lit(start).cast("date")
    lot = ["lot_id", "campus"]
    before, since = cells.filter(F.col("date") < first).drop("date"), cells.filter(F.col("date") >= first).drop("date")
    known = F.when(F.col("is_exam_week").isNotNull(), F.col("window_start"))
    carried = before.groupBy(*lot).agg(
        F.max_by("occupancy_now", "window_start").alias("occupancy_now"), F.max_by("is_exam_week", known).alias("is_exam_week"))
    if carried.isEmpty() or not join_nulls(since.select(*lot), carried, lot, "left_anti").isEmpty():
        return features_of(cells.drop("date"), holidays)
    # The state before the first window of ``start``, as a window of its own.
    border = carried.withColumns({"window_start": shift(first.cast("timestamp"), minutes=-15), "departures": F.lit(0).cast("bigint")})
    return features_of(since.unionByName(border), holidays).filter(F.col("timestamp") >= first.cast("timestamp"))


def training_features(events: DataFrame, holidays: list[str] = HOLIDAYS) -> DataFrame:
    """One row per lot and 15-minute window with state, calendar and both labels.

    * The events are only summed per window; all later steps work on lots x windows.
    * ``occupancy_now`` is the window's closing state, carried over gaps; before a lot's first window it is 0.
    * ``occupancy_plus_15m`` is the next window's state, 0 after the last window.
    * ``departures_in_15m`` counts the row's *own* window, whose closing state is ``occupancy_now``: the label is
      partly known from the feature, as in the model it reproduces.
    * Holiday and weekend come from the date; the exam flag is the window's last known one, carried over gaps,
      and null before the first.
    """
    return features_of(window_state(events), holidays)


def features_of(cells: DataFrame, holidays: list[str] = HOLIDAYS) -> DataFrame:
    """The feature table from the windows' states; ``cells`` is read twice, so a job stores it first."""
    if "is_exam_week" not in cells.columns:
        cells = cells.withColumn("is_exam_week", F.lit(None).cast("boolean"))
    day = F.to_date("window_start")
    return dense_grid(cells).select(
        "lot_id", "campus", F.col("window_start").alias("timestamp"), "occupancy_now",
        day_of_week(day).alias("day_of_week"), hour_of_day(F.col("window_start")).alias("hour_of_day"),
        in_days(day, as_dates(holidays)).alias("is_holiday"), is_weekend(day).alias("is_weekend"), "is_exam_week",
        F.col("occupancy_next").alias("occupancy_plus_15m"), F.col("departures").alias("departures_in_15m"),
    )
