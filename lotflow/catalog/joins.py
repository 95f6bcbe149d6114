"""Joins."""

from pyspark.sql import functions as F

from lotflow.catalog.base import PERIOD_SQL, query
from lotflow.fixtures import CALENDAR
from lotflow.operators import calendar as C
from lotflow.operators import grid as G
from lotflow.operators import serving
from lotflow.operators import sessions as S
from lotflow.operators.occupancy import departures_per_window
from lotflow.operators.validate import with_capacity
from lotflow.sources.events import unify_historical, unify_realtime

TERM = ("2024-01-02", "2024-01-27")
DATES_SQL = "(select unnest(generate_series(date '2024-01-02', date '2024-01-27', interval 1 day)) as date)"


@query("pair_sessions", "select session_id, arrival_ts, departure_ts, lot_id, campus, student_id, plate_number, cast(date as varchar) as date from pairs")
def _(g):
    return S.pair_sessions(g.valid).drop("arrival_id")


@query("impute_departures", "select session_id, event_type, event_ts, lot_id, campus, student_id, plate_number, cast(date as varchar) as date from clean")
def _(g):
    return S.impute_departures(g.valid)


@query("attach_duration", "select c.session_id, event_type, event_ts, duration_seconds from clean c left join durations using (session_id)")
def _(g):
    return S.attach_duration(g.stored("clean")).select("session_id", "event_type", "event_ts", "duration_seconds")


@query("attach_capacity", "select event_id, n.lot_id, coalesce(capacity, -1) as capacity from named n left join capacity using (lot_id)")
def _(g):
    from lotflow.operators.validate import standardise_names

    joined = with_capacity(standardise_names(g.raw), g.capacity)
    return joined.select("event_id", "lot_id", F.coalesce("capacity", F.lit(-1)).alias("capacity"))


@query("calendar_backfill", """select event_id, cast(is_holiday as varchar) as is_holiday, cast(is_weekend as varchar) as is_weekend,
    cast(is_exam_week as varchar) as is_exam_week, cast(is_first_2_weeks as varchar) as is_first_2_weeks,
    cast(is_special_day as varchar) as is_special_day from unified where event_ts >= timestamp '2024-01-23 12:00:00'""")
def _(g):
    calendar = C.calendar_of(unify_historical(g.historical))
    return C.backfill_flags(unify_realtime(g.live), calendar).select("event_id", *C.FLAG_NAMES)


@query("time_skeleton", "select lot_id, campus, w as window_start from skeleton")
def _(g):
    return G.time_skeleton(g.stored("cells"))


@query("fill_grid", "select lot_id, campus, w as window_start, coalesce(occ, -99) as occupancy_now, occ is not null as observed from skeleton left join cells using (lot_id, campus, w)")
def _(g):
    grid = G.fill_grid(g.stored("cells"))
    return grid.select("lot_id", "campus", "window_start", F.coalesce("occupancy_now", F.lit(-99)).alias("occupancy_now"),
                       F.col("occupancy_now").isNotNull().alias("observed"))


def _grid(g):
    return g.stored("features").select("lot_id", "campus", F.col("timestamp").alias("window_start"), "occupancy_now")


@query("label_occupancy_next", """select f.lot_id, f.campus, f.w as window_start, f.occ as occupancy_now, coalesce(n.occ, 0) as occupancy_plus_15m
    from filled f left join filled n on n.lot_id = f.lot_id and n.w = f.w + interval 15 minutes""")
def _(g):
    return G.join_next_window(_grid(g), "occupancy_now", "occupancy_plus_15m").fillna(0, subset=["occupancy_plus_15m"])


@query("label_departures", "select lot_id, campus, w as window_start, occ as occupancy_now, dep as departures_in_15m from filled")
def _(g):
    return G.label_departures(_grid(g), departures_per_window(g.unified))


@query("matched_departures", """select event_id, session_id from valid v where event_type = 'DEPARTURE'
    and exists (select 1 from valid a where a.event_type = 'ARRIVAL' and a.session_id = v.session_id)""")
def _(g):
    return S.with_arrival(g.valid).select("event_id", "session_id")


@query("orphan_departures", """select event_id, session_id from valid v where event_type = 'DEPARTURE'
    and not exists (select 1 from valid a where a.event_type = 'ARRIVAL' and a.session_id = v.session_id)""")
def _(g):
    return S.without_arrival(g.valid).select("event_id", "session_id")


@query("sample_entities_semi", """select event_id, student_id from ev where student_id in (
    select student_id from (select student_id, row_number() over (order by md5(student_id)) as rn, count(*) over () as n
    from (select distinct student_id from ev)) where rn <= greatest(1, cast(floor(n * cast(0.12 as double)) as bigint)))""")
def _(g):
    return C.sample_entities(g.ev, "student_id", 0.12).select("event_id", "student_id")


@query("expand_weekly_template", f"""select student_id, campus, weekday, day, start_time, end_time, cast(cast(date as date) as varchar) as date
    from template join {DATES_SQL} on isodow(date) = weekday""")
def _(g):
    return C.expand_weekly_template(g.template, *TERM)


@query("expand_by_letter", f"""select student_id, campus, weekday, day, start_time, end_time, cast(cast(date as date) as varchar) as date
    from template join {DATES_SQL} on isodow(date) <= 5 and contains(day, substr(strftime(date, '%a'), 1, 1))""")
def _(g):
    return C.expand_weekly_template(g.template, *TERM, by_letter=True)


@query("classify_period", f"select event_id, cast(date as varchar) as date, {PERIOD_SQL} as period from ev")
def _(g):
    return C.classify_period(g.ev, **CALENDAR).select("event_id", "date", "period")


@query("split_population", """select student_id, case when row_number() over (order by md5(student_id))
    <= floor(count(*) over () * cast(0.9 as double)) then 1 else 2 end as population
    from (select distinct student_id from ev)""")
def _(g):
    return C.split_population(g.ev, "student_id", 0.9)


@query("lot_details", f"""select c.lot_id, c.campus_name, c.capacity, c.current_occupancy, coalesce(h.average_occupancy_lot, 0) as avg_occ,
    coalesce(h.average_duration_minutes, 0) as avg_dur, ch.hours, ch.chart_total, a.activity, f.forecast_time,
    f.predicted_occupancy_count, f.predicted_num_departures, f.predicted_occupancy_pct from current c
    left join (select * from history where day_of_week = 'Mon' and hour_of_day = 9) h using (lot_id)
    left join (select lot_id, string_agg(printf('%02d:00', hour_of_day), ',' order by hour_of_day) as hours,
        cast(sum(cast(round(average_occupancy_lot * 1000) as bigint)) as bigint) as chart_total from history where day_of_week = 'Mon' group by 1) ch using (lot_id)
    left join (select lot_id, string_agg(event_id || ':' || event_type, ',' order by event_timestamp desc, event_id desc) as activity
        from recent group by 1) a using (lot_id)
    left join (select * from forecasts qualify row_number() over (partition by lot_id order by forecast_time desc) = 1) f using (lot_id)""")
def _(g):
    details = serving.lot_details(g.stored("current"), g.stored("history"), g.stored("recent"), g.stored("forecasts"), F.lit("Mon"), F.lit(9))
    thousandths = F.transform("chart", lambda p: F.round(p["pct"] * 1000).cast("bigint"))
    return details.select(
        "lot_id", "campus_name", "capacity", "current_occupancy", "avg_occ", "avg_dur",
        F.array_join(F.transform("chart", lambda p: p["time"]), ",").alias("hours"),
        F.aggregate(thousandths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chart_total"),
        F.array_join(F.transform("activity", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_type"])), ",").alias("activity"),
        "forecast_time", "predicted_occupancy_count", "predicted_num_departures", "predicted_occupancy_pct",
    )
