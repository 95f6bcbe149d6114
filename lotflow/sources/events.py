"""Event readers: landed Parquet folders, exports and stream records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.domain import EXPORT_TS, capacity_rows
from lotflow.functions.text import day_in_path, decode_record, standard_name
from lotflow.functions.timeparts import strict_ts
from lotflow.operators.calendar import FLAG_NAMES
from lotflow.schemas import CAPACITY, CLEAN, FLAGS, HISTORICAL, WIRE
from lotflow.session import literal_rows

#: Landed events: wire fields with the folder columns ``lot_id`` and ``date``.
LANDED = T.StructType([*[f for f in WIRE.fields if f.name != "lot_id"], T.StructField("lot_id", T.StringType()),
                       T.StructField("date", T.DateType())])

#: Columns of the unified log.
UNIFIED = ("session_id", "event_ts", "lot_id", "campus", "event_type", "student_id", "plate_number", *FLAG_NAMES, "date")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The folder's rows, or no rows if the folder is missing; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_day(spark: SparkSession, root: str, day: str) -> DataFrame:
    """One day's landed events of all lots; only that day's folders are read."""
    return read_or_empty(spark, root, LANDED).filter(F.col("date") == F.lit(day).cast("date"))


def scan_clean_day(spark: SparkSession, root: str, day: str) -> DataFrame:
    return read_or_empty(spark, root, CLEAN).filter(F.col("date") == F.lit(day).cast("date"))


def has_day(events: DataFrame, day: str) -> DataFrame:
    """One row telling whether any campus has the date; stops at the first row found."""
    found = events.filter(F.col("date") == F.lit(day).cast("date")).select("date").limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("found"))


def scan_realtime(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` in the wire layout; the lot, which names a folder, is taken from there."""
    return spark.read.schema(LANDED).parquet(root).select(*WIRE.fieldNames())


def with_path_day(events: DataFrame, path: Column | None = None) -> DataFrame:
    return events.withColumn("date", day_in_path(F.col("_metadata.file_path") if path is None else path))


def scan_historical(spark: SparkSession, root: str) -> DataFrame:
    """The historical log with unified names, upper-case keys and snake-case flags."""
    schema = T.StructType([*HISTORICAL.fields, T.StructField("date", T.DateType())])
    return unify_historical(spark.read.schema(schema).parquet(root))


def _tie(rows: DataFrame, ts: str) -> Column:
    """What orders events of one instant: their id, or a hash of the event where the log has none."""
    if "event_id" in rows.columns:
        return F.col("event_id")
    return F.xxhash64("session_id", ts, "lot_id", "event_type", "student_id").alias("event_id")


def unify_historical(rows: DataFrame) -> DataFrame:
    flags = [F.col(old).alias(new) for old, new in zip(FLAGS, FLAG_NAMES)]
    return rows.select(
        "session_id", F.col("timestamp").alias("event_ts"), standard_name(F.col("lot_id")).alias("lot_id"),
        standard_name(F.col("campus")).alias("campus"), standard_name(F.col("event_type")).alias("event_type"),
        F.col("student_id").cast("int").alias("student_id"), F.lit(None).cast("string").alias("plate_number"),
        *flags, "date", _tie(rows, "timestamp"),
    )


def unify_realtime(rows: DataFrame) -> DataFrame:
    """Live text events in the unified layout; flags stay null until the calendar fills them."""
    ts = strict_ts(F.col("timestamp"))
    return rows.select(
        "session_id", ts.alias("event_ts"), standard_name(F.col("lot_id")).alias("lot_id"),
        standard_name(F.col("campus")).alias("campus"), standard_name(F.col("event_type")).alias("event_type"),
        F.col("student_id").try_cast("int").alias("student_id"), "plate_number",
        *[F.lit(None).cast("boolean").alias(f) for f in FLAG_NAMES], F.to_date(ts).alias("date"), _tie(rows, "timestamp"),
    )


def union_sources(history: DataFrame, live: DataFrame) -> DataFrame:
    return history.unionByName(live, allowMissingColumns=True)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """CSV export of the historical log with a header line."""
    return spark.read.schema(HISTORICAL).option("header", "true").option("timestampFormat", EXPORT_TS).csv(path)


def decode_events(records: DataFrame, data: str = "data", schema: T.StructType = WIRE) -> DataFrame:
    """Base64 JSON records as columns; an unreadable record is kept whole in ``_corrupt``."""
    return records.withColumn("_r", decode_record(F.col(data), schema)).select(
        *[c for c in records.columns if c != data], "_r.*")


def capacity_table(spark: SparkSession, campus_lots: dict | None = None) -> DataFrame:
    """The lot dimension, one row per lot."""
    rows = capacity_rows(campus_lots) if campus_lots else capacity_rows()
    return literal_rows(spark, rows, CAPACITY)
