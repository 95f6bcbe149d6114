"""The shape of physical plans: what is read, what moves, and how."""

from lotflow.operators import occupancy as O
from lotflow.operators import serving as V
from lotflow.operators import sessions as S
from lotflow.sources.events import scan_day
from lotflow.sources.sinks import write_landed
from lotflow.schemas import WIRE
from lotflow.session import shared_dir

def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_type_filter_and_columns_reach_the_scan(given):
    text = plan(given.pe.select("event_id", "event_ts"))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in text
    assert "ReadSchema" in text and "props" not in text and "user_id" not in text


def test_one_day_reads_one_folder_per_lot(spark, given):
    path = shared_dir(spark, "landed")
    write_landed(given.raw.select(*WIRE.fieldNames(), "date"), path)
    text = plan(scan_day(spark, path, "2024-01-10"))
    assert "PartitionFilters: [isnotnull(date" in text


def test_top_k_is_cut_before_the_shuffle(given):
    text = plan(V.recent_events(given.pe))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_sessions_are_combined_before_their_one_shuffle(given):
    text = plan(S.pair_sessions(given.pe))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text and "Join" not in text


def test_running_sum_moves_events_by_piece(given):
    text = plan(O.running_occupancy_rows(given.pe))
    assert "hashpartitioning(lot_id" in text
    moved = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line]
    assert moved and all("_slice" in line and "_block" in line for line in moved)
