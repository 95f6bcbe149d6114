"""Running values against plain loops, with limits so small that every kind of piece occurs."""

import random
from datetime import datetime, timedelta

import pytest

from lotflow.operators import occupancy as O
from lotflow.operators.hourly import hourly_metrics, peak_spikes
from lotflow.operators.ordered import PIECE, global_rank, with_pieces
from lotflow.sources.events import capacity_table

SMALL = {"hot_rows": 3}
SIZES = {"BURNABY": {"EAST": 4, "WEST": 2}}


def random_log(seed, n=400):
    """Many ties: a third of the events share one instant of one lot."""
    draw = random.Random(seed)
    start = datetime(2024, 1, 10, 23, 59, 50)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            ts, lot = start, "EAST"
        else:
            ts = start + timedelta(seconds=draw.choice([0, 1, 1, 2, 15, 4000]), microseconds=draw.choice([0, 0, 1, 500]))
            lot = draw.choice(["EAST", "WEST"])
        rows.append((f"s{i // 2}", ts.isoformat(" "), draw.choice("AD"), lot))
    return rows


def as_list(events):
    return [(r["event_id"], r["lot_id"], r["event_ts"], 1 if r["event_type"] == "ARRIVAL" else -1) for r in events.collect()]


@pytest.mark.parametrize("limits", [{}, SMALL, {"hot_rows": 0}])
def test_running_sum_by_row_and_by_instant(make_events, limits):
    events = make_events(random_log(1))
    log = sorted(as_list(events), key=lambda e: (e[2], e[0]))
    by_row, by_instant, sums = {}, {}, {}
    for i, lot, ts, d in log:
        sums[lot, ts.date()] = by_row[i] = sums.get((lot, ts.date()), 0) + d
        by_instant[lot, ts] = by_row[i]
    rows = O.running_occupancy_rows(events, **limits).collect()
    assert {r["event_id"]: r["occupancy_now"] for r in rows} == by_row
    shared = O.daily_running_occupancy(events, **limits).collect()
    assert len(shared) == len(log)
    assert all(r["current_occupancy"] == by_instant[r["lot_id"], r["event_ts"]] for r in shared)


@pytest.mark.parametrize("limits", [{}, SMALL, {"hot_rows": 0}])
@pytest.mark.parametrize("block", [O.BLOCK_ROWS, 2])
def test_clamped_walk(spark, make_events, monkeypatch, limits, block):
    monkeypatch.setattr(O, "BLOCK_ROWS", block)
    events = make_events(random_log(2))
    walk, state, days = {}, {}, {}
    for i, lot, ts, d in sorted(as_list(events), key=lambda e: (e[2], e[0])):
        cap = SIZES["BURNABY"][lot]
        walk[i] = state[lot] = max(0, min(cap, state.get(lot, 0) + d))
        days[lot, ts.date()] = max(0, min(cap, days.get((lot, ts.date()), 0) + d))
    capacity = capacity_table(spark, SIZES)
    rows = O.clamped_occupancy(events, capacity, **limits).collect()
    assert {r["event_id"]: r["occupancy"] for r in rows} == walk
    final = O.current_occupancy(events, capacity, **limits).collect()
    assert {r["lot_id"]: r["current_occupancy"] for r in final} == state
    assert all(r["free_spots"] == r["capacity"] - r["current_occupancy"] for r in final)
    daily = O.daily_counts(events, capacity, **limits).collect()
    assert {(r["lot_id"], r["date"]): r["occupancy"] for r in daily} == days


@pytest.mark.parametrize("ids", ["dense", "hashed", "some null", "all null"])
def test_no_row_is_lost_at_any_size(make_events, ids):
    """Rows without lot, and ids that are null or hashed: as many rows, the same sums by instant, for every limit."""
    from pyspark.sql import functions as F

    new_id = {"dense": F.col("event_id"), "hashed": F.xxhash64("event_id"), "all null": F.lit(None).cast("bigint"),
              "some null": F.when(F.col("event_id") % 10 > 0, F.col("event_id"))}[ids]
    events = make_events(random_log(5)).withColumns({
        "number": F.col("event_id"), "event_id": new_id, "lot_id": F.when(F.col("event_id") % 7 > 0, F.col("lot_id"))})
    found = []
    for limits in ({}, SMALL, {"hot_rows": 20}):
        by_row = O.running_occupancy_rows(events, **limits)
        assert by_row.count() == 400
        last = {(r["lot_id"], r["date"]): r["n"] for r in by_row.groupBy("lot_id", "date").agg(F.count("number").alias("n")).collect()}
        shared = {r["number"]: r["current_occupancy"] for r in O.daily_running_occupancy(events, **limits).collect()}
        rows = {r["number"]: r["occupancy_now"] for r in by_row.collect()}
        found.append((last, shared, rows))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 400


@pytest.mark.parametrize("ids", ["counted", "one far id", "one shared id", "half shared", "all null", "hashed"])
def test_a_hot_instant_is_cut_evenly(spark, ids):
    """2,000 events of one instant, cut at 100: no piece above twice the limit, and pieces follow the order of rows."""
    from pyspark.sql import functions as F

    n = F.col("id")
    new_id = {"counted": n, "one far id": F.when(n == 7, 2**62).otherwise(n), "one shared id": F.lit(5).cast("bigint"),
              "half shared": F.when(n % 2 == 0, 700).otherwise(n), "all null": F.lit(None).cast("bigint"),
              "hashed": F.xxhash64("id")}[ids]
    events = spark.range(2000).select(
        F.lit("EAST").alias("lot_id"), F.lit("2024-01-10 10:00:00").cast("timestamp").alias("event_ts"),
        new_id.cast("bigint").alias("event_id"), n.alias("number"))
    rows = with_pieces(events, ["lot_id"], hot_rows=100).collect()
    sizes = {}
    for r in rows:
        key = tuple(r[p] for p in PIECE)
        sizes[key] = sizes.get(key, 0) + 1
    assert len(rows) == 2000 and len(sizes) >= 10 and max(sizes.values()) <= 200
    order = lambda r: (r["event_id"] is not None, r["event_id"] or 0, r["_spread"])
    blocks = [r["_block"] for r in sorted(rows, key=order)]
    assert blocks == sorted(blocks)


def test_hourly_metrics_against_a_loop(spark, make_events):
    events = make_events(random_log(3))
    log = [(r["session_id"], r["lot_id"], r["date"], r["event_ts"], r["event_type"]) for r in events.collect()]
    ends = {}
    for s, _, _, ts, kind in log:
        first = ends.setdefault(s, {})
        first[kind] = max(first.get(kind, ts), ts)
    stay = {s: int(e["DEPARTURE"].replace(microsecond=0).timestamp() - e["ARRIVAL"].replace(microsecond=0).timestamp())
            for s, e in ends.items() if len(e) == 2}
    cells = {}
    for s, lot, day, ts, _ in log:
        occ = sum(1 if k == "ARRIVAL" else -1 for _, l2, d2, t2, k in log if (l2, d2) == (lot, day) and t2 <= ts)
        cells.setdefault((lot, day.strftime("%a"), ts.hour), []).append((occ, stay.get(s)))
    rows = hourly_metrics(events, capacity_table(spark, SIZES)).collect()
    assert len(rows) == len(cells)
    for r in rows:
        seen = cells[r["lot_id"], r["day_of_week"], r["hour_of_day"]]
        stays = [x for _, x in seen if x is not None]
        assert r["max_occupancy_hourly"] == max(o for o, _ in seen)
        assert r["average_occupancy_lot"] == pytest.approx(sum(o for o, _ in seen) / len(seen))
        assert r["average_duration_minutes"] == (pytest.approx(sum(stays) / len(stays) / 60) if stays else None)


def test_peak_flag_starts_at_the_threshold(spark):
    rows = [("EAST", "Mon", 8, 1.0, 1.0, 8, 10), ("EAST", "Mon", 9, 1.0, 1.0, 7, 10), ("NEW", "Mon", 8, 1.0, 1.0, 9, None)]
    hours = spark.createDataFrame(rows, "lot_id string, day_of_week string, hour_of_day int, average_duration_minutes double,"
                                        " average_occupancy_lot double, max_occupancy_hourly bigint, lot_capacity bigint")
    assert [r["peak_spikes_count"] for r in peak_spikes(hours).collect()] == [1, 0, 0]


def test_invalid_types_never_count(make_events):
    events = make_events([("a", "2024-01-10 08:00:00", "A", "EAST"), ("a", "2024-01-10 08:01:00", "ERROR", "EAST")])
    assert [r["occupancy_now"] for r in O.running_occupancy_rows(events).collect()] == [1]


def test_global_rank_is_the_sorted_position(spark):
    from pyspark.sql import functions as F

    ids = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    hashes = sorted(r["h"] for r in ids.collect())
    ranked = {r["h"]: r["_rank"] for r in global_rank(ids, "h").collect()}
    assert ranked == {h: i + 1 for i, h in enumerate(hashes)}
