"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.domain import EXPORT_TS
from lotflow.functions.text import to_record


def _balanced(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a folder together in few tasks; a folder with very many rows is split over several."""
    return rows.hint("rebalance", *[F.col(k) for k in keys])


def write_clean(events: DataFrame, path: str) -> None:
    """Cleaned events by campus and date; only the dates at hand are replaced."""
    placed = _balanced(events, "campus", "date").sortWithinPartitions("campus", "date", "event_ts")
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("campus", "date").parquet(path))


def write_landed(events: DataFrame, path: str) -> None:
    """Raw events in one folder per lot and day."""
    _balanced(events, "lot_id", "date").write.mode("append").partitionBy("lot_id", "date").parquet(path)


def write_training_set(features: DataFrame, path: str) -> None:
    """The feature table in files of even size, each in time order per lot."""
    placed = _balanced(features, "lot_id").sortWithinPartitions("lot_id", "timestamp")
    placed.write.mode("overwrite").parquet(path)


def export_training_csv(rows: DataFrame, label: str, features: list[str], path: str) -> None:
    """Header-less CSV with the label first, one file per task."""
    numbers = [F.col(c).cast("int") if t == "boolean" else F.col(c) for c, t in rows.select(label, *features).dtypes]
    rows.select(*numbers).write.mode("overwrite").option("header", "false").csv(path)


def write_export(rows: DataFrame, path: str) -> None:
    """CSV with a header line and times to the microsecond."""
    rows.write.mode("overwrite").option("header", "true").option("timestampFormat", EXPORT_TS).csv(path)


def convert_export(rows: DataFrame, path: str) -> None:
    """Historical rows as Parquet by campus and date."""
    dated = rows.withColumn("date", F.to_date("timestamp"))
    _balanced(dated, "campus", "date").write.mode("overwrite").partitionBy("campus", "date").parquet(path)


def to_stream_records(events: DataFrame, *fields: str) -> DataFrame:
    """(key, value) records for a stream sink; the lot is the key, so one lot's events stay in order."""
    return events.select(F.col("lot_id").alias("key"), to_record(*fields).alias("value"))
