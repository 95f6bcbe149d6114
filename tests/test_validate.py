import pytest

from lotflow.functions.text import encode_record
from lotflow.operators.validate import accepted, quarantined, validate
from lotflow.schemas import WIRE
from lotflow.sources.events import decode_events

AS_OF = "2024-01-10 12:00:00"
GOOD = ("S1", "2024-01-10T10:00:00.000001Z", "arrival ", " north", "burnaby", "7", "AB123C")


def changed(**fields):
    return tuple(fields.get(f, v) for f, v in zip(WIRE.fieldNames(), GOOD))


@pytest.mark.parametrize("row, reason", [
    (GOOD, None),
    (changed(session_id=""), "missing:session_id"),
    (changed(plate_number=None), "missing:plate_number"),
    (changed(student_id="", plate_number=""), "missing:student_id"),
    (changed(event_type="PARKED"), "event_type"),
    (changed(event_type="PARKED", campus="X"), "event_type"),
    (changed(campus="VICTORIA"), "campus"),
    (changed(lot_id="SRYC"), "lot"),
    (changed(campus=" surrey ", lot_id="sryc"), None),
    (changed(lot_id="   "), "lot"),
    (changed(timestamp="yesterday"), "timestamp"),
    (changed(timestamp="2024-01-10T10:00:00"), "timestamp"),
    (changed(timestamp="2024-01-10T10:00:00Z"), None),
    (changed(timestamp="2024-01-10T04:00:30-08:00"), None),
    (changed(timestamp="2024-01-10T04:01:01-08:00"), "timestamp"),
    (changed(timestamp="2024-01-10T12:01:00Z"), None),
    (changed(timestamp="2024-01-10T12:01:00.000001Z"), "timestamp"),
])
def test_first_broken_rule(spark, row, reason):
    checked = validate(spark.createDataFrame([row], WIRE), AS_OF)
    assert checked.first()["reason"] == reason
    assert accepted(checked).count() == (reason is None)
    assert quarantined(checked).count() == (reason is not None)


def test_unreadable_records_are_set_aside(spark):
    sent = spark.createDataFrame([GOOD], WIRE).select(encode_record(*WIRE.fieldNames()).alias("data"))
    broken = spark.createDataFrame([("{not json",), ("bm90IGpzb24=",)], "data string")
    checked = validate(decode_events(sent.unionByName(broken)), AS_OF)
    rows = [r["reason"] for r in checked.collect()]
    assert sorted(rows, key=str) == sorted([None, "bad_json", "bad_json"], key=str)
    assert accepted(checked).first()["lot_id"] == "NORTH"
