"""Declared schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

from lotflow.domain import REQUIRED

#: An event as sent: seven text fields.
WIRE = T.StructType([T.StructField(name, T.StringType()) for name in REQUIRED])

#: A cleaned event; ``campus`` and ``date`` are partition columns.
CLEAN = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("lot_id", T.StringType()),
    T.StructField("student_id", T.StringType()),
    T.StructField("plate_number", T.StringType()),
    T.StructField("campus", T.StringType()),
    T.StructField("date", T.DateType()),
])

FLAGS = ("isHoliday", "isWeekend", "isExamWeek", "isFirst2Weeks", "isSpecialDay")

#: The historical log as exported to CSV.
HISTORICAL = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("lot_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("student_id", T.IntegerType()),
    T.StructField("campus", T.StringType()),
    *[T.StructField(f, T.BooleanType()) for f in FLAGS],
])

CAPACITY = T.StructType([
    T.StructField("campus", T.StringType(), False),
    T.StructField("lot_id", T.StringType(), False),
    T.StructField("capacity", T.LongType(), False),
])

SEMESTER = T.StructType([
    T.StructField("semester", T.StringType(), False),
    T.StructField("start", T.DateType(), False),
    T.StructField("class_end", T.DateType(), False),
    T.StructField("sem_end", T.DateType(), False),
])

CURRENT = T.StructType([
    T.StructField("lot_id", T.StringType()),
    T.StructField("campus_name", T.StringType()),
    T.StructField("capacity", T.LongType()),
    T.StructField("current_occupancy", T.LongType()),
    T.StructField("free_spots", T.LongType()),
    T.StructField("occupancy_rate", T.DoubleType()),
    T.StructField("last_updated_ts", T.TimestampType()),
])

RECENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("lot_id", T.StringType()),
    T.StructField("campus_name", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_timestamp", T.TimestampType()),
])

HISTORY = T.StructType([
    T.StructField("lot_id", T.StringType(), False),
    T.StructField("day_of_week", T.StringType(), False),
    T.StructField("hour_of_day", T.IntegerType(), False),
    T.StructField("average_occupancy_lot", T.DecimalType(10, 4)),
    T.StructField("average_duration_minutes", T.DecimalType(10, 2)),
    T.StructField("peak_spikes_count", T.IntegerType()),
])

FORECAST = T.StructType([
    T.StructField("lot_id", T.StringType()),
    T.StructField("forecast_time", T.TimestampType()),
    T.StructField("run_time", T.TimestampType()),
    T.StructField("predicted_occupancy_count", T.LongType()),
    T.StructField("predicted_num_departures", T.LongType()),
    T.StructField("predicted_occupancy_pct", T.DoubleType()),
])
