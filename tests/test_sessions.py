from datetime import date, datetime

from pyspark.sql import functions as F

from lotflow.operators import sessions as S


def test_missing_departure_is_four_hours_later_on_the_arrival_date(make_events):
    clean = S.impute_departures(make_events([("a", "2024-01-10 22:30:00", "A", "EAST")]))
    rows = {r["event_type"]: r for r in clean.collect()}
    assert rows["DEPARTURE"]["event_ts"] == datetime(2024, 1, 11, 2, 30)
    assert rows["DEPARTURE"]["date"] == date(2024, 1, 10)


def test_repeats_and_orphans(make_events):
    events = make_events([
        ("a", "2024-01-10 08:00:00", "A", "EAST"), ("a", "2024-01-10 08:05:00", "A", "EAST"),
        ("a", "2024-01-10 10:00:00", "D", "EAST"), ("a", "2024-01-10 11:00:00", "D", "EAST"),
        ("b", "2024-01-10 09:00:00", "D", "EAST"),
    ])
    pairs = S.pair_sessions(events).collect()
    assert [(r["session_id"], r["arrival_ts"].hour, r["departure_ts"].hour) for r in pairs] == [("a", 8, 10)]
    assert [r["session_id"] for r in S.without_arrival(events).collect()] == ["b"]
    assert S.with_arrival(events).count() == 2
    assert S.first_of_each(events).count() == 3


def test_sessions_without_an_id_are_not_merged(make_events):
    events = make_events([(None, "2024-01-10 08:00:00", "A", "EAST"), (None, "2024-01-10 09:00:00", "A", "WEST"),
                          (None, "2024-01-10 10:00:00", "D", "EAST")])
    assert S.pair_sessions(events).count() == 2


def test_pivot_without_departures_has_both_columns(make_events):
    pivoted = S.session_pivot(make_events([("a", "2024-01-10 08:00:00", "A", "EAST")]))
    assert pivoted.columns == ["session_id", "arrival_ts", "departure_ts"]
    assert S.complete_only(pivoted).count() == 0


def test_durations_cut_both_ends_to_seconds(make_events):
    events = make_events([("a", "2024-01-10 08:00:00.900000", "A", "EAST"), ("a", "2024-01-10 08:01:00.100000", "D", "EAST")])
    assert S.session_durations(events).first()["duration_seconds"] == 60
    attached = S.attach_duration(events)
    assert attached.filter(F.col("duration_minutes") == 1.0).count() == 2


def test_every_arrival_has_exactly_one_departure(given):
    counts = given.clean.groupBy("session_id").pivot("event_type", ["ARRIVAL", "DEPARTURE"]).count()
    assert counts.filter("ARRIVAL <> 1 or DEPARTURE <> 1 or ARRIVAL is null or DEPARTURE is null").isEmpty()
