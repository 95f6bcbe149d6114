"""Aggregations and data checks."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.operators import calendar as C
from lotflow.operators import explore as X
from lotflow.operators import grid as G
from lotflow.operators import hourly as H
from lotflow.operators import sessions as S
from lotflow.operators.occupancy import departures_per_window, window_state
from lotflow.operators.validate import parse_strict
from lotflow.sources.events import unify_historical


@query("session_pivot", """select session_id, max(case when event_type = 'ARRIVAL' then event_ts end) as arrival_ts,
    max(case when event_type = 'DEPARTURE' then event_ts end) as departure_ts from pe_dup group by 1""")
def _(g):
    return S.session_pivot(g.pe_dup)


@query("session_durations", "select session_id, duration_seconds, duration_seconds / cast(60 as double) as duration_minutes from durations")
def _(g):
    return S.session_durations(g.stored("clean"))


@query("first_of_each", """select session_id, event_type, event_ts, event_id from pe_dup
    qualify row_number() over (partition by session_id, event_type order by event_ts, event_id) = 1""")
def _(g):
    return S.first_of_each(g.pe_dup).select("session_id", "event_type", "event_ts", "event_id")


@query("hourly_metrics", "select * from hours")
def _(g):
    return g.hours


@query("peak_spikes", "select * from history")
def _(g):
    return g.history


@query("history_rollup", """select lot_id, hour_of_day, count(*) as weekdays, avg(average_occupancy_lot) as average_occupancy_lot,
    avg(average_occupancy_lot) * cast(100 as double) / cast(max(lot_capacity) as double) as average_occupancy_pct from hours group by 1, 2""")
def _(g):
    return H.history_rollup(g.stored("hours"))


@query("window_state_15m", """select lot_id, campus, w as window_start, occ as occupancy_now, cast(exam as varchar) as is_exam_week, dep as departures
    from cells""")
def _(g):
    return window_state(g.unified)


@query("departures_15m", """select lot_id, time_bucket(interval 15 minutes, event_ts) as window_start, count(*) as departures_in_15m
    from pe where event_type = 'DEPARTURE' group by 1, 2""")
def _(g):
    return departures_per_window(g.pe)


@query("time_bounds", "select min(w) as min_ts, max(w) as max_ts from cells")
def _(g):
    return G.time_bounds(g.stored("cells"))


@query("distinct_lots", "select distinct lot_id, campus from ev")
def _(g):
    return g.ev.select("lot_id", "campus").distinct()


@query("distinct_students", "select distinct student_id from ev")
def _(g):
    return g.ev.select("student_id").distinct()


@query("calendar_dim", """select cast(date as varchar) as date, cast(is_holiday as varchar) as is_holiday, cast(is_weekend as varchar) as is_weekend,
    cast(is_exam_week as varchar) as is_exam_week, cast(is_first_2_weeks as varchar) as is_first_2_weeks,
    cast(is_special_day as varchar) as is_special_day from histdays""")
def _(g):
    return C.calendar_of(unify_historical(g.historical))


@query("holiday_audit", "select cast(is_holiday as varchar) as is_holiday, count(*) as n from unified group by 1")
def _(g):
    return X.flag_audit(g.unified)


@query("holiday_by_date", "select cast(date as varchar) as date, cast(max(is_holiday) as varchar) as is_holiday from unified group by 1 order by 1")
def _(g):
    return X.flag_by_date(g.unified)


@query("row_counts", "select count(*) as rows_before, count(event_ts) as rows_after from named")
def _(g):
    return X.row_counts(parse_strict(g.raw))


@query("daily_student_summary", """select student_id, cast(cast(date as date) as varchar) as date, campus, min(start_time) as first_start,
    max(end_time) as last_end from template join (select unnest(generate_series(date '2024-01-02', date '2024-01-27', interval 1 day)) as date)
    on isodow(date) = weekday group by all""")
def _(g):
    return C.daily_summary(C.expand_weekly_template(g.template, "2024-01-02", "2024-01-27"))


@query("avg_by_hour", "select hour_of_day, avg(occupancy_now) as avg_occupancy_now from features group by 1")
def _(g):
    return X.mean_by(g.stored("features"), "hour_of_day")


@query("avg_by_weekday", "select day_of_week, avg(occupancy_now) as avg_occupancy_now from features group by 1")
def _(g):
    return X.mean_by(g.stored("features"), "day_of_week")


@query("median_by_time", "select timestamp, median(occupancy_now) as median_occupancy from features group by 1")
def _(g):
    return X.median_by_time(g.stored("features"))


@query("capacity_check", """select lot_id, max_occupancy, capacity, cast(max_occupancy > capacity as varchar) as over_capacity from
    (select lot_id, max(occupancy_now) as max_occupancy from features group by 1) left join (select lot_id, capacity from capacity) using (lot_id)""")
def _(g):
    return X.capacity_check(g.stored("features"), g.capacity)


@query("over_capacity", """select lot_id, max_occupancy, capacity, 'true' as over_capacity from
    (select lot_id, max(occupancy_now) as max_occupancy from features group by 1)
    join (select lot_id, capacity from capacity) using (lot_id) where max_occupancy > capacity""")
def _(g):
    return X.over_capacity(g.stored("features"), g.capacity)


@query("max_departures", """select lot_id, max(departures_in_15m) as max_departures from features group by 1
    union all select 'ALL', max(departures_in_15m) from features""")
def _(g):
    return X.max_departures(g.stored("features"))


@query("avg_by_flag", """select 'is_holiday' as flag, cast(is_holiday as varchar) as value, avg(occupancy_now) as avg_occupancy_now from features group by 2
    union all select 'is_weekend', cast(is_weekend as varchar), avg(occupancy_now) from features group by 2""")
def _(g):
    def part(flag):
        return X.mean_by(g.stored("features"), flag).select(F.lit(flag).alias("flag"), F.col(flag).cast("string").alias("value"), "avg_occupancy_now")

    return part("is_holiday").unionByName(part("is_weekend"))


@query("flag_value_counts", " union all ".join(
    f"select '{f}' as flag, coalesce(cast({f} as varchar), 'null') as value, count(*) as n from features group by 2"
    for f in X.FLAGS))
def _(g):
    return X.flag_value_counts(g.stored("features"))


COLUMNS = ["lot_id", "campus", "timestamp", "occupancy_now", "day_of_week", "hour_of_day", "is_holiday", "is_weekend",
           "is_exam_week", "occupancy_plus_15m", "departures_in_15m"]


@query("null_counts", " union all ".join(
    f"select count(*) as n_rows, '{c}' as column_name, count(*) - count({c}) as nulls, 11 as n_columns from features"
    for c in COLUMNS))
def _(g):
    return X.null_counts(g.stored("features"))


@query("describe_holiday", """select count(occupancy_now) as n, round(avg(occupancy_now), 6) as mean, round(stddev(occupancy_now), 6) as std,
    min(occupancy_now) as min, quantile_cont(occupancy_now, 0.25) as p25, quantile_cont(occupancy_now, 0.5) as p50,
    quantile_cont(occupancy_now, 0.75) as p75, max(occupancy_now) as max from features where is_holiday""")
def _(g):
    rows = X.describe(g.stored("features").filter("is_holiday"), "occupancy_now")
    return rows.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("conditional_count", "select count(*) filter (where occupancy_now > 0) as n_positive from features where is_holiday")
def _(g):
    return X.positive_count(g.stored("features").filter("is_holiday"), "occupancy_now")


def _histogram_sql(value: str, bins: int) -> str:
    return f"""select b.bin, coalesce(h.n, 0) as n from (select unnest(range(1, {bins + 1})) as bin) b left join
        (select least(cast(floor(({value} - lo) / ((hi - lo) / cast({bins} as double))) as bigint) + 1, {bins}) as bin, count(*) as n
        from features, (select cast(min({value}) as double) as lo, cast(max({value}) as double) as hi from features) group by 1) h using (bin)"""


@query("histogram_occupancy", _histogram_sql("occupancy_now", 50))
def _(g):
    return X.histogram(g.stored("features"), "occupancy_now", 50)


@query("histogram_departures", _histogram_sql("departures_in_15m", 30))
def _(g):
    return X.histogram(g.stored("features"), "departures_in_15m", 30)


@query("boxplot_stats", """select lot_id, min(occupancy_now) as min, quantile_cont(occupancy_now, 0.25) as p25,
    quantile_cont(occupancy_now, 0.5) as p50, quantile_cont(occupancy_now, 0.75) as p75, max(occupancy_now) as max from features group by 1""")
def _(g):
    return X.boxplot_stats(g.stored("features"))


CORR = [*X.NUMERIC, *X.FLAGS]


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr(cast(cast({a} as int) as double), cast(cast({b} as int) as double)), 6) as r from features"
    for i, a in enumerate(CORR) for b in CORR[i:]))
def _(g):
    return X.correlation_matrix(g.stored("features"))
