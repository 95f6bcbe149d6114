"""Sorts, limits, unions and merges."""

from pyspark.sql import functions as F

from lotflow.catalog.base import PERIOD_SQL, query
from lotflow.fixtures import AS_OF, CALENDAR, SWITCH
from lotflow.operators import explore as X
from lotflow.operators import merge as M
from lotflow.operators import serving as V
from lotflow.operators.calendar import classify_period
from lotflow.operators.hourly import hourly_metrics, peak_spikes
from lotflow.operators.occupancy import apply_run, lot_runs, snapshot
from lotflow.operators.sessions import as_events, close_sessions, pair_sessions
from lotflow.sources.events import union_sources, unify_historical, unify_realtime

BREAK = "2024-01-16"


@query("events_chronological", "select event_id, event_ts, lot_id from ev order by event_ts, event_id")
def _(g):
    return V.chronological(g.ev).select("event_id", "event_ts", "lot_id")


@query("lots_by_campus", """select *, cast(round_even(occupancy_rate * cast(100 as double), 2) as double) as occupancy_rate_pct
    from snapshot order by lot_id""")
def _(g):
    return V.lots_by_campus(g.stored("current"))


@query("lots_of_one_campus", """select *, cast(round_even(occupancy_rate * cast(100 as double), 2) as double) as occupancy_rate_pct
    from snapshot where campus_name = 'SURREY' order by lot_id""")
def _(g):
    return V.lots_by_campus(g.stored("current"), "surrey")


ACTIVITY_SQL = """select event_id, lot_id, campus_name, event_type, event_timestamp, strftime(event_timestamp, '%Y-%m-%d') as date,
    strftime(event_timestamp, '%H:%M:%S') as time, event_type as event from recent"""


@query("recent_activity", ACTIVITY_SQL)
def _(g):
    return V.recent_activity(g.stored("recent"))


@query("recent_activity_of_lot", ACTIVITY_SQL + " where lot_id = 'NORTH'")
def _(g):
    return V.recent_activity(g.stored("recent"), "NORTH")


HISTORY_SQL = "select lot_id, hour_of_day, average_occupancy_lot, peak_spikes_count from history where day_of_week = 'Wed'"


@query("history_for_weekday", HISTORY_SQL)
def _(g):
    return V.history_for_weekday(g.stored("history"), "Wed")


@query("history_of_lot", HISTORY_SQL + " and lot_id = 'NORTH'")
def _(g):
    return V.history_for_weekday(g.stored("history"), "Wed", "NORTH")


@query("latest_forecast", "select * from forecasts qualify row_number() over (partition by lot_id order by forecast_time desc) = 1")
def _(g):
    return V.latest_forecast(g.stored("forecasts"))


@query("current_hour_metrics", """select c.lot_id, coalesce(average_occupancy_lot, 0) as avg_occ, coalesce(average_duration_minutes, 0) as avg_dur
    from capacity c left join (select * from history where day_of_week = 'Sat' and hour_of_day = 4) h using (lot_id)""")
def _(g):
    return V.current_hour_metrics(g.capacity, g.stored("history"), F.lit("Sat"), F.lit(4))


KEY_SQL = "lot_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M')"


@query("sample_rows", f"select lot_id, timestamp, occupancy_now, occupancy_plus_15m from features order by md5({KEY_SQL}) limit 5000")
def _(g):
    key = F.concat_ws("|", F.col("lot_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm"))
    return X.sample_rows(g.stored("features").select("lot_id", "timestamp", "occupancy_now", "occupancy_plus_15m"), key, 5000)


@query("lot_timeline", "select lot_id, timestamp, occupancy_now from features order by 1, 2")
def _(g):
    return X.lot_timeline(g.stored("features")).select("lot_id", "timestamp", "occupancy_now")


@query("timeline_of_lot", "select timestamp, occupancy_now from features where lot_id = 'EAST' order by 1")
def _(g):
    return X.lot_timeline(g.stored("features"), "EAST").select("timestamp", "occupancy_now")


@query("due_events", f"select event_id, event_ts from ev where event_ts <= timestamp '{AS_OF}' order by event_ts, event_id limit 50")
def _(g):
    return V.due_events(g.ev, AS_OF).select("event_id", "event_ts")


@query("union_events", """select session_id, 'ARRIVAL' as event_type, arrival_ts as event_ts from closed union all
    select session_id, 'DEPARTURE', departure_ts from closed""")
def _(g):
    return as_events(close_sessions(pair_sessions(g.valid))).select("session_id", "event_type", "event_ts")


@query("union_history_realtime", """select event_id, session_id, event_ts, lot_id, campus, event_type, student_id, plate_number,
    case when event_ts < timestamp '2024-01-23 12:00:00' then cast(is_holiday as varchar) end as is_holiday from unified""")
def _(g):
    live = unify_realtime(g.live).drop("is_holiday")
    rows = union_sources(unify_historical(g.historical), live)
    return rows.select("event_id", "session_id", "event_ts", "lot_id", "campus", "event_type", "student_id", "plate_number", "is_holiday")


@query("union_periods", f"select event_id, period from (select event_id, {PERIOD_SQL} as period from ev) where period <> 'out'")
def _(g):
    rows = classify_period(g.ev, **CALENDAR).select("event_id", "period")
    # The union of the four periods' rows, in one pass.
    return rows.filter(F.col("period").isin("busy", "regular", "exam", "off_day"))


def _half(g, early: bool):
    day = F.col("date") < F.lit(BREAK).cast("date")
    return peak_spikes(hourly_metrics(g.stored("clean").filter(day if early else ~day), g.capacity))


def _history_sql(part: str) -> str:
    """Hourly history of one half of the days, spelled out on the cleaned log."""
    return f"""(select r.lot_id, strftime(r.date, '%a') as day_of_week, hour(r.event_ts) as hour_of_day,
        cast(sum(r.occ) as double) / cast(count(*) as double) as average_occupancy_lot,
        cast(sum(d.duration_seconds) as double) / cast(count(d.duration_seconds) as double) / cast(60 as double) as average_duration_minutes,
        case when cast(max(r.occ) as double) / max(c.capacity) >= cast(0.8 as double) then 1 else 0 end as peak_spikes_count
        from running r left join durations d using (session_id) left join capacity c on c.lot_id = r.lot_id
        where r.date {part} date '{BREAK}' group by 1, 2, 3)"""


@query("merge_history", f"""select * from {_history_sql('>=')} union all select * from {_history_sql('<')} o
    where not exists (select 1 from {_history_sql('>=')} n where n.lot_id = o.lot_id and n.day_of_week = o.day_of_week and n.hour_of_day = o.hour_of_day)""")
def _(g):
    return M.merge_history(_half(g, True), _half(g, False))


@query("merge_current", "select * from snapshot")
def _(g):
    cut = F.col("event_ts") < F.lit(SWITCH).cast("timestamp")
    before = snapshot(lot_runs(g.pe.filter(cut), g.capacity), g.capacity, apply_run(F.lit(0).cast("bigint")))
    return M.merge_current(before, lot_runs(g.pe.filter(~cut), g.capacity), g.capacity)


MERGED_FORECAST_SQL = f"""(select * replace (case when run_time >= timestamp '{SWITCH}' then predicted_num_departures + 1
    else predicted_num_departures end as predicted_num_departures) from forecasts)"""


def _rerun(g):
    """Later runs made again with other numbers."""
    later = g.stored("forecasts").filter(F.col("run_time") >= F.lit(SWITCH).cast("timestamp"))
    return later.withColumn("predicted_num_departures", F.col("predicted_num_departures") + 1)


@query("merge_forecast", f"select * from {MERGED_FORECAST_SQL}")
def _(g):
    return M.merge_forecast(g.stored("forecasts"), _rerun(g))


@query("save_forecast", f"select * from {MERGED_FORECAST_SQL} qualify row_number() over (partition by lot_id order by run_time desc) <= 5")
def _(g):
    return M.merge_forecast(g.stored("forecasts"), _rerun(g), keep=5)
