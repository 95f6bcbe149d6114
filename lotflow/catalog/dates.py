"""Calendar functions."""

from pyspark.sql import functions as F

from lotflow.catalog.base import days, flags_sql, query
from lotflow.domain import as_dates
from lotflow.fixtures import CALENDAR, HOLIDAYS, SPECIAL
from lotflow.functions import timeparts as P
from lotflow.operators.calendar import with_day_flags
from lotflow.operators.grid import time_skeleton


@query("hour_of_day", "select event_id, hour(event_ts) as hour_of_day from ev")
def _(g):
    return g.ev.select("event_id", P.hour_of_day(F.col("event_ts")).alias("hour_of_day"))


@query("day_of_week", "select event_id, dayofweek(event_ts) + 1 as day_of_week from ev")
def _(g):
    return g.ev.select("event_id", P.day_of_week(F.col("event_ts")).alias("day_of_week"))


@query("weekday_name", "select event_id, strftime(event_ts, '%a') as weekday from ev")
def _(g):
    return g.ev.select("event_id", P.weekday_name(F.col("event_ts")).alias("weekday"))


@query("is_weekend", "select event_id, cast(dayofweek(event_ts) in (0, 6) as varchar) as is_weekend from ev")
def _(g):
    return g.ev.select("event_id", P.is_weekend(F.to_date("event_ts")).alias("is_weekend"))


@query("is_holiday", f"select event_id, cast(date in {days(HOLIDAYS)} as varchar) as is_holiday from ev")
def _(g):
    return g.ev.select("event_id", P.in_days(F.col("event_ts"), as_dates(HOLIDAYS)).alias("is_holiday"))


@query("day_flags", "select event_id, " + ", ".join(
    f"cast({text} as varchar) as {name}" for name, text in flags_sql("date").items()) + " from ev")
def _(g):
    flagged = with_day_flags(g.ev, **CALENDAR, special_days=SPECIAL)
    return flagged.select("event_id", "is_holiday", "is_weekend", "is_exam_week", "is_first_2_weeks", "is_special_day")


@query("window_start", "select event_id, time_bucket(interval 15 minutes, event_ts) as window_start from ev")
def _(g):
    return g.ev.select("event_id", P.window_start(F.col("event_ts")).alias("window_start"))


@query("grid_floor", "select event_id, time_bucket(interval 15 minutes, event_ts) as window_start from ev")
def _(g):
    return g.ev.select("event_id", P.grid_floor(F.col("event_ts")).alias("window_start"))


@query("grid_explode", """select t as grid_time, count(*) as lots from skeleton, lateral (select w as t) group by 1""")
def _(g):
    grid = time_skeleton(g.stored("cells"))
    return grid.groupBy(F.col("window_start").alias("grid_time")).agg(F.count(F.lit(1)).alias("lots"))
