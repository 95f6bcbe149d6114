from datetime import datetime

from pyspark.sql import functions as F

from lotflow.operators import grid as G
from lotflow.operators.occupancy import departures_per_window, window_state
from lotflow.plans.features import features_from, features_of, training_features


def test_small_feature_table(make_events):
    events = make_events([
        ("a", "2024-01-13 23:20:00", "A", "EAST"), ("b", "2024-01-13 23:21:00", "A", "EAST"),
        ("a", "2024-01-13 23:50:00", "D", "EAST"), ("c", "2024-01-14 00:20:00", "A", "EAST"),
        ("d", "2024-01-13 23:50:00", "A", "SRYC"),
    ]).withColumn("is_exam_week", F.when(F.col("session_id") == "b", True))
    rows = {(r["lot_id"], r["timestamp"]): r for r in training_features(events, ["2024-01-14"]).collect()}
    assert len(rows) == 2 * 5
    east = [rows["EAST", datetime(2024, 1, 13, 23, 15)], rows["EAST", datetime(2024, 1, 13, 23, 30)],
            rows["EAST", datetime(2024, 1, 13, 23, 45)], rows["EAST", datetime(2024, 1, 14, 0, 0)],
            rows["EAST", datetime(2024, 1, 14, 0, 15)]]
    # The count restarts at midnight, but a gap after midnight still carries the old state.
    assert [r["occupancy_now"] for r in east] == [2, 2, 1, 1, 1]
    assert [r["occupancy_plus_15m"] for r in east] == [2, 1, 1, 1, 0]
    assert [r["departures_in_15m"] for r in east] == [0, 0, 1, 0, 0]
    assert [r["is_exam_week"] for r in east] == [True] * 5
    assert [r["is_holiday"] for r in east] == [False, False, False, True, True]
    assert [r["is_weekend"] for r in east] == [True] * 5
    surrey = [rows["SRYC", t["timestamp"]] for t in east]
    assert [r["occupancy_now"] for r in surrey] == [0, 0, 1, 1, 1]
    assert [r["occupancy_plus_15m"] for r in surrey] == [0, 1, 1, 1, 0]
    assert [r["is_exam_week"] for r in surrey] == [None] * 5
    assert east[0]["day_of_week"] == 7 and east[4]["day_of_week"] == 1


def test_one_pass_grid_equals_the_single_steps(given):
    cells = window_state(given.unified)
    steps = G.forward_fill(G.fill_grid(cells), "occupancy_now", "is_exam_week").fillna(0, subset=["occupancy_now"])
    joined = G.join_next_window(steps, "occupancy_now", "joined").fillna(0, subset=["joined"])
    led = G.next_window_value(joined, "occupancy_now", "led").fillna(0, subset=["led"])
    assert led.filter("joined <> led").isEmpty()
    slow = G.label_departures(led, departures_per_window(given.unified)).select(
        "lot_id", "campus", "window_start", "occupancy_now", "is_exam_week", F.col("led").alias("occupancy_next"),
        F.col("departures_in_15m").alias("departures"))
    fast = G.dense_grid(cells)
    assert fast.count() == slow.count()
    assert fast.exceptAll(slow.select(*fast.columns)).isEmpty()


def test_features_from_a_date_on_are_those_of_all_cells(spark, make_events):
    """Carried states, gaps of whole days, a null flag, and a lot that appears late."""
    events = make_events([
        ("a", "2024-01-10 08:00:00", "A", "EAST"), ("b", "2024-01-10 23:50:00", "A", "EAST"), ("c", "2024-01-10 09:00:00", "A", "SRYC"),
        ("d", "2024-01-13 00:20:00", "A", "EAST"), ("a", "2024-01-14 00:00:00", "D", "EAST"), ("e", "2024-01-14 07:00:00", "A", "WEST"),
    ]).withColumn("is_exam_week", F.when(F.col("session_id") == "b", True))
    cells = window_state(events).withColumn("date", F.to_date("window_start"))
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    for until in ("2024-01-13", "2024-01-14"):
        stored = cells.filter(F.col("date") <= F.lit(until).cast("date"))
        whole = features_of(stored.drop("date"))
        for start in ("2024-01-10", "2024-01-13"):
            since = whole.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
            # WEST is new on the 14th, so every row is written again.
            wanted = whole if until == "2024-01-14" else since
            assert rows(features_from(stored, start)) == rows(wanted)
    later = cells.filter("lot_id <> 'WEST'")
    assert rows(features_from(later, "2024-01-14")) == rows(
        features_of(later.drop("date")).filter(F.col("timestamp") >= F.lit("2024-01-14").cast("timestamp")))


def test_events_are_summed_before_they_move(given):
    plan = window_state(given.pe)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange hashpartitioning(lot_id")[-1]
    assert "partial_sum" in before_shuffle
    assert "value" in plan and "props" not in plan
