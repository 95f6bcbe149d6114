"""Every named query against its SQL in the other engine."""

import os

import pytest

import __spark_entry__ as entry
from lotflow.catalog import QUERIES
from verify import compare, connect

#: A query of every family; LOTFLOW_ALL=1 runs all but the fitted ones, as ``verify.py`` does.
SPREAD = """quarantine validate_events parse_iso_ts unify_schema previous_local_day cap_departure_at_day_end off_day_split
pair_sessions impute_departures attach_duration calendar_backfill time_skeleton label_occupancy_next label_departures
orphan_departures sample_entities_semi expand_weekly_template classify_period split_population lot_details
session_pivot hourly_metrics window_state_15m null_counts correlation_matrix histogram_occupancy boxplot_stats
daily_running_occupancy running_occupancy_rows forward_fill recent_events_topk forecast_retention clamped_occupancy
current_occupancy merge_history merge_current save_forecast sample_rows round_predictions json_roundtrip occupancy_judgement
display_text day_flags scan_day date_from_path csv_to_parquet decode_events write_clean stage_then_merge declare_table
stream_validate stream_live batch_metrics stream_dedup stream_window_15m daily_close history_rollup training_features nightly_features score_current""".split()
FITTED = {"forecast", "forecast_cycle", "train_occupancy", "train_departures", "train_departures_linear", "evaluate", "forecast_values", "predictions", "model_errors"}
NAMES = [n for n in QUERIES if n not in FITTED] if os.environ.get("LOTFLOW_ALL") else SPREAD


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    table = entry.entry(spark)
    assert table.columns[:3] == ["lot_id", "campus", "timestamp"] and not table.isEmpty()


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    table = entry.queries()[name](spark, sf_dir)
    plan = table._jdf.queryExecution().executedPlan().toString()
    # No join pairs everything with everything, and nothing goes through Python.  What a stream did, its timers included,
    # is not part of the plan.
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"))
    assert compare(con, name, table) == ""
