"""Data checks and summary statistics over the feature table."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("is_holiday", "is_weekend", "is_exam_week")
NUMERIC = ("occupancy_now", "occupancy_plus_15m", "departures_in_15m", "day_of_week", "hour_of_day")


def flag_audit(events: DataFrame, flag: str = "is_holiday") -> DataFrame:
    """Rows per flag value, and the flag of each date."""
    return events.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


def flag_by_date(events: DataFrame, flag: str = "is_holiday") -> DataFrame:
    return events.groupBy("date").agg(F.max(flag).alias(flag)).orderBy("date")


def row_counts(events: DataFrame) -> DataFrame:
    """All rows and rows with a time, in one pass."""
    return events.agg(F.count(F.lit(1)).alias("rows_before"), F.count("event_ts").alias("rows_after"))


def mean_by(features: DataFrame, key: str, value: str = "occupancy_now") -> DataFrame:
    return features.groupBy(key).agg(F.avg(value).alias(f"avg_{value}"))


def median_by_time(features: DataFrame) -> DataFrame:
    return features.groupBy("timestamp").agg(F.median("occupancy_now").alias("median_occupancy"))


def capacity_check(features: DataFrame, capacity: DataFrame) -> DataFrame:
    """Highest count per lot against its capacity."""
    tops = features.groupBy("lot_id").agg(F.max("occupancy_now").alias("max_occupancy"))
    dim = capacity.select("lot_id", "capacity")
    over = F.coalesce(F.col("max_occupancy") > F.col("capacity"), F.lit(False))
    return tops.join(dim, "lot_id", "left").withColumn("over_capacity", over)


def over_capacity(features: DataFrame, capacity: DataFrame) -> DataFrame:
    return capacity_check(features, capacity).filter("over_capacity")


def max_departures(features: DataFrame) -> DataFrame:
    """Highest departure count per lot, and over all lots under ``ALL``; rows without a lot stay under null."""
    tops = features.rollup("lot_id").agg(F.max("departures_in_15m").alias("max_departures"), F.grouping("lot_id").alias("_all"))
    return tops.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("lot_id")).alias("lot_id"), "max_departures")


def flag_value_counts(features: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Rows per flag and value, nulls included."""
    long = features.select(*flags).unpivot([], list(flags), "flag", "value")
    text = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    return long.groupBy("flag", text.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def null_counts(table: DataFrame) -> DataFrame:
    """Nulls per column with the number of rows and columns."""
    counts = table.agg(F.count(F.lit(1)).alias("n_rows"),
                       *[F.count_if(F.col(c).isNull()).alias(c) for c in table.columns])
    long = counts.unpivot(["n_rows"], table.columns, "column_name", "nulls")
    return long.withColumn("n_columns", F.lit(len(table.columns)).cast("bigint"))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles."""
    quartiles = F.percentile(value, [0.25, 0.5, 0.75])
    return rows.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"),
        F.min(value).alias("min"), quartiles.getItem(0).alias("p25"), quartiles.getItem(1).alias("p50"),
        quartiles.getItem(2).alias("p75"), F.max(value).alias("max"),
    )


def positive_count(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(value) > 0).alias("n_positive"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the lowest to the highest value, the last one closed; empty bins are rows too.

    Values are counted first, so the bins are laid over distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    low, high = counts.agg(F.min("v").alias("x")).scalar(), counts.agg(F.max("v").alias("x")).scalar()
    # All values alike: one unit wide around the value, as plotting libraries do.
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / F.lit(float(bins))
    index = F.least(F.floor((F.col("v") - start) / width) + 1, F.lit(bins).cast("bigint"))
    filled = counts.groupBy(index.alias("bin")).agg(F.sum("n").alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return every.join(filled, "bin", "left").fillna(0, subset=["n"])


def boxplot_stats(features: DataFrame) -> DataFrame:
    """Five-number summary of the count per lot."""
    quartiles = F.percentile("occupancy_now", [0.25, 0.5, 0.75])
    return features.groupBy("lot_id").agg(
        F.min("occupancy_now").alias("min"), quartiles.getItem(0).alias("p25"),
        quartiles.getItem(1).alias("p50"), quartiles.getItem(2).alias("p75"), F.max("occupancy_now").alias("max"),
    )


def correlation_matrix(features: DataFrame, columns: tuple[str, ...] = (*NUMERIC, *FLAGS)) -> DataFrame:
    """Pearson correlation of every pair in long form, all pairs in one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    number = {c: F.col(c).cast("int").cast("double") for c in columns}
    wide = features.agg(*[F.corr(number[a], number[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], wide.columns, "pair", "r")
    split = F.split("pair", r"\|")
    return long.select(split.getItem(0).alias("a"), split.getItem(1).alias("b"), F.round("r", 6).alias("r"))


def sample_rows(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """A repeatable sample of ``n`` rows: the first by hash of the key."""
    hashed = rows.withColumn("_hash", F.md5(key))
    return hashed.orderBy("_hash").limit(n).drop("_hash")


def lot_timeline(features: DataFrame, lot: str | None = None) -> DataFrame:
    """A lot's rows, or every lot's, in time order."""
    rows = features if lot is None else features.filter(F.col("lot_id") == lot)
    return rows.orderBy("lot_id", "timestamp")
