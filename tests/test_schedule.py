"""Forecasts by the clock: every grid time once, also those missed while the job stood still."""

import time
from datetime import datetime

from lotflow.domain import MODEL_FEATURES
from lotflow.fixtures import CALENDAR
from lotflow.plans import forecast as P
from lotflow.plans.boosted_trees import BoostedTrees
from lotflow.schemas import FORECAST
from lotflow.session import shared_dir
from lotflow.sources.versions import finished, read_latest


def test_due_times():
    at = lambda minute: datetime(2024, 1, 30, 10, minute)
    assert P.due_times(None, datetime(2024, 1, 30, 10, 17, 3)) == [at(15)]
    assert P.due_times(at(0), at(44)) == [at(15), at(30)]
    assert P.due_times(at(30), at(44)) == [] and P.due_times(at(45), at(44)) == []


def test_missed_runs_are_made_up_for_once(spark, given):
    models, root, checkpoint = (shared_dir(spark, x) for x in ("models", "forecasts", "checkpoint"))
    plain = lambda name, objective: BoostedTrees(MODEL_FEATURES, name, objective, 0.5, 1)
    P.store_models(spark, plain("occupancy_raw", "squared"), plain("departures_raw", "poisson"), models)
    now, asked = [datetime(2024, 1, 30, 10, 1)], []

    def snapshot(due):
        asked.append(due)
        return given.current

    def run(until):
        query = P.schedule_forecasts(spark, snapshot, models, root, checkpoint, "1 second", lambda: now[0], **CALENDAR)
        end = time.time() + 120
        while len(finished(spark, root)) < until and time.time() < end and query.exception() is None:
            time.sleep(0.5)
        # More ticks at the same time add nothing.
        seen = len(query.recentProgress)
        while len(query.recentProgress) < seen + 2 and time.time() < end:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None

    run(1)
    now[0] = datetime(2024, 1, 30, 10, 47)
    run(4)
    assert asked == [datetime(2024, 1, 30, 10, m) for m in (0, 15, 30, 45)]
    rows = read_latest(spark, root, FORECAST).collect()
    assert len(rows) == len({(r["lot_id"], r["run_time"]) for r in rows}) == 4 * 7
