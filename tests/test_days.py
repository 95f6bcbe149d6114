import json
from datetime import date

from lotflow.session import shared_dir
from lotflow.sources.events import capacity_table
from lotflow.streaming import days as D
from lotflow.streaming import jobs as J

AS_OF = "2024-02-01 00:00:00"


def record(i, lot, kind, day, hour):
    return {"session_id": f"s{i}", "timestamp": f"2024-01-{day:02d}T{hour:02d}:00:00.000000Z", "event_type": kind, "lot_id": lot,
            "campus": "BURNABY", "student_id": "1", "plate_number": "P", "event_id": i}


def test_a_silent_lot_is_empty_the_next_day(spark, tmp_path):
    root, first, second = (shared_dir(spark, x) for x in ("daily", "fold", "close"))
    capacity = capacity_table(spark, {"BURNABY": {"EAST": 2, "WEST": 5}})

    def run(name, records):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")
        events = J.accepted_events(J.read_records(spark, str(tmp_path), files_per_batch=1), AS_OF)
        D.fold_days(events, capacity, root, first).awaitTermination()
        D.close_days(spark, root, second).awaitTermination()
        return {(r["lot_id"], r["date"].day): (r["occupancy"], r["closed"]) for r in D.read_days(spark, root).collect()}

    day10 = run("1.json", [record(1, "EAST", "ARRIVAL", 10, 8), record(2, "EAST", "ARRIVAL", 10, 9),
                           record(3, "EAST", "ARRIVAL", 10, 10), record(4, "WEST", "ARRIVAL", 10, 8)])
    assert day10 == {("EAST", 10): (2, False), ("WEST", 10): (1, False)}
    # Only WEST sends anything, three days later; EAST is closed by the clock.
    later = run("2.json", [record(5, "WEST", "ARRIVAL", 13, 8)])
    assert later == {("EAST", 10): (2, True), ("EAST", 11): (0, True), ("EAST", 12): (0, True), ("EAST", 13): (0, False),
                     ("WEST", 10): (1, True), ("WEST", 11): (0, True), ("WEST", 12): (0, True), ("WEST", 13): (1, False)}
    # A late departure changes its closed day, an arrival the open one; nothing else moves.
    late = run("3.json", [record(6, "EAST", "DEPARTURE", 10, 23)])
    assert late == later | {("EAST", 10): (1, True)}
    now = run("4.json", [record(7, "EAST", "ARRIVAL", 13, 9)])
    assert now == late | {("EAST", 13): (1, False)}
    assert run("5.json", [record(8, "WEST", "DEPARTURE", 14, 1)])[("EAST", 14)] == (0, False)
    assert date(2024, 1, 13) in [r["date"] for r in D.read_days(spark, root).filter("closed and lot_id = 'EAST' and occupancy = 1").collect()]
