"""Merges by key, as new tables: Parquet has no in-place update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.operators.occupancy import apply_run, snapshot
from lotflow.operators.serving import newest_per_lot

HISTORY_KEY = ("lot_id", "day_of_week", "hour_of_day")
FORECAST_KEY = ("lot_id", "forecast_time")


def replace_by_key(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows, and the old rows whose key is not among them."""
    kept = old.join(new.select(*key), list(key), "left_anti")
    return new.unionByName(kept.select(*new.columns))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(old, new, *HISTORY_KEY)


def merge_forecast(old: DataFrame, new: DataFrame, keep: int | None = None) -> DataFrame:
    """Replace by lot and target time; ``keep`` then holds on to the newest runs of each lot."""
    merged = replace_by_key(old, new, *FORECAST_KEY)
    return merged if keep is None else newest_per_lot(merged, "run_time", keep, "forecast_time")


def merge_current(old: DataFrame, runs: DataFrame, capacity: DataFrame) -> DataFrame:
    """Move the snapshot on by one triple per lot; a lot seen for the first time starts empty.

    All three inputs have one row per lot.
    """
    before = old.select("lot_id", F.col("current_occupancy").alias("_old"), F.col("last_updated_ts").alias("_old_ts"))
    both = before.join(runs, "lot_id", "full")
    start = F.coalesce("_old", F.lit(0).cast("bigint"))
    held = F.when(F.col("s").isNull(), start).otherwise(apply_run(start))
    rows = both.withColumn("last_updated_ts", F.coalesce("last_updated_ts", "_old_ts"))
    return snapshot(rows, capacity, held)


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counts per key, added up; nulls in the key are equal."""
    return old.unionByName(new.select(*old.columns)).groupBy(*key).agg(F.sum(count).alias(count))


def merge_days(old: DataFrame, runs: DataFrame) -> DataFrame:
    """Move counts kept per lot and date on by one triple each; a new date starts empty."""
    both = old.withColumnRenamed("occupancy", "_old").join(runs, ["lot_id", "date"], "full")
    start = F.coalesce("_old", F.lit(0).cast("bigint"))
    moved = F.when(F.col("s").isNull(), start).otherwise(apply_run(start))
    return both.select("lot_id", "date", moved.alias("occupancy"))
