from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lotflow.operators import merge as M
from lotflow.operators import serving as V
from lotflow.operators.occupancy import current_occupancy, lot_runs
from lotflow.plans.nightly import run_clean, run_history
from lotflow.schemas import CLEAN, CURRENT, FORECAST, HISTORY, WIRE
from lotflow.session import shared_dir
from lotflow.sources import versions as R
from lotflow.sources.events import capacity_table
from lotflow.sources.sinks import write_clean, write_landed

HOUR = datetime(2024, 1, 10, 8)


def runs_of(spark, n, departures=1):
    rows = [("EAST", HOUR + timedelta(minutes=15 * (i + 1)), HOUR + timedelta(minutes=15 * i), 5, departures, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, FORECAST)


def test_forecast_merge_replaces_and_trims(spark):
    merged = M.merge_forecast(runs_of(spark, 8), runs_of(spark, 8, departures=9).filter("minute(run_time) = 45"), keep=5)
    rows = sorted(merged.collect(), key=lambda r: r["run_time"])
    assert len(rows) == 5 and rows[-1]["predicted_num_departures"] == 9 and rows[-2]["predicted_num_departures"] == 1
    newest = V.latest_forecast(merged).first()
    assert newest["forecast_time"] == HOUR + timedelta(minutes=120)


def test_replace_by_key_twice_changes_nothing(given):
    once = M.merge_history(given.history, given.history)
    assert once.exceptAll(given.history).isEmpty() and once.count() == given.history.count()


def test_snapshot_moved_on_in_parts_equals_all_at_once(spark, given):
    empty = spark.createDataFrame([], CURRENT)
    early = F.col("event_ts") < F.lit("2024-01-15 13:00:00").cast("timestamp")
    first = M.merge_current(empty, lot_runs(given.pe.filter(early), given.capacity), given.capacity)
    second = M.merge_current(first, lot_runs(given.pe.filter(~early), given.capacity), given.capacity)
    assert second.exceptAll(current_occupancy(given.pe, given.capacity)).isEmpty()
    # A batch without events of a lot leaves the lot as it was.
    third = M.merge_current(second, lot_runs(given.pe.filter("lot_id = 'EAST' and event_id < 0"), given.capacity), given.capacity)
    assert third.exceptAll(second).isEmpty() and third.count() == second.count()


def test_current_hour_without_history_is_zero(spark):
    history = spark.createDataFrame([("EAST", "Mon", 8, 4.5, 60.0, 0)], "lot_id string, day_of_week string, hour_of_day int,"
                                    " average_occupancy_lot double, average_duration_minutes double, peak_spikes_count int")
    rows = V.current_hour_metrics(capacity_table(spark), history, F.lit("Mon"), F.lit(8)).collect()
    assert len(rows) == 7
    assert {r["lot_id"]: (r["avg_occ"], r["avg_dur"]) for r in rows}["EAST"] == (4.5, 60.0)
    assert {(r["avg_occ"], r["avg_dur"]) for r in rows if r["lot_id"] != "EAST"} == {(0.0, 0.0)}


def test_versions(spark):
    root = shared_dir(spark, "versions")
    assert R.finished(spark, root) == [] and R.read_latest(spark, root, FORECAST).isEmpty()
    assert R.add_version(runs_of(spark, 1), root) == 0
    assert R.add_version(runs_of(spark, 2), root) == 1
    assert R.read_latest(spark, root, FORECAST).count() == 2
    assert R.read_latest(spark, root, FORECAST, before=1).count() == 1


def test_writing_a_day_again_keeps_the_other_days(spark, given):
    path = shared_dir(spark, "clean")
    write_clean(given.clean, path)
    write_clean(given.clean.filter("date = date'2024-01-10'"), path)
    assert spark.read.schema(CLEAN).parquet(path).count() == given.clean.count()


def test_nightly_jobs(spark, given):
    landed, clean, history = (shared_dir(spark, x) for x in ("landed", "clean", "history"))
    tidy = given.pe.withColumn("timestamp", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    write_landed(tidy.select(*WIRE.fieldNames(), "date"), landed)
    as_of = "2024-01-11 09:00:00"
    assert run_clean(spark, landed, clean, as_of)
    assert not run_clean(spark, landed, clean, "2025-01-11 09:00:00")
    assert run_history(spark, clean, history, given.capacity, as_of)
    assert not run_history(spark, clean, history, given.capacity, "2025-01-11 09:00:00")
    first = R.read_latest(spark, history, HISTORY).collect()
    assert run_history(spark, clean, history, given.capacity, as_of)
    assert sorted(R.read_latest(spark, history, HISTORY).collect()) == sorted(first)
    assert {r["day_of_week"] for r in first} == {"Wed"}
