"""Registration, and the shared part of the check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.fixtures import AS_OF, HOLIDAYS, SPECIAL, SWITCH, Given
from lotflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def days(listed: list[str]) -> str:
    return "(" + ", ".join(f"date '{d}'" for d in listed) + ")"


def flags_sql(d: str) -> dict[str, str]:
    """The five day flags of a date expression."""
    off = f"(dayofweek({d}) in (0, 6) or {d} in {days(HOLIDAYS)})"
    term = f"{d} between date '2024-01-02' and date '2024-01-27'"
    return {
        "is_holiday": f"({d} in {days(HOLIDAYS)})",
        "is_weekend": f"(dayofweek({d}) in (0, 6))",
        "is_exam_week": f"({term} and not {off} and {d} > date '2024-01-20')",
        "is_first_2_weeks": f"({term} and not {off} and {d} < date '2024-01-16')",
        "is_special_day": f"({d} in {days(SPECIAL)})",
    }


def _flag_columns(d: str) -> str:
    return ", ".join(f"{text} as {name}" for name, text in flags_sql(d).items())


PERIOD_SQL = f"""case when date not between date '2024-01-02' and date '2024-01-27' then 'out'
    when dayofweek(date) in (0, 6) or date in {days(HOLIDAYS)} then 'off_day'
    when date < date '2024-01-16' then 'busy' when date <= date '2024-01-20' then 'regular' else 'exam' end"""

_PLACE = """'S' || event_id as session_id,
    (['NORTH','EAST','CENTRAL','WEST','SOUTH','SRYC','SRYE'])[1 + user_id % 7] as lot_id,
    case when user_id % 7 < 5 then 'BURNABY' else 'SURREY' end as campus,
    cast(user_id as varchar) as student_id, 'P' || user_id as plate_number"""

#: Shared tables of the check SQL, in order of use.
TABLES = {
    "parked": f"""select 2 * event_id as event_id, ts as event_ts,
        case when event_type = 'error' then 'ERROR' else 'ARRIVAL' end as event_type, {_PLACE} from events
        union all select 2 * event_id + 1, ts + to_seconds(cast(floor(value * 240) as bigint)), 'DEPARTURE', {_PLACE}
        from events where event_type in ('click', 'view', 'purchase')""",
    "pe": "select *, cast(event_ts as date) as date from parked where event_type <> 'ERROR'",
    "ev": "select *, cast(event_ts as date) as date from parked",
    "pe_min": "select * replace (date_trunc('minute', event_ts) as event_ts) from pe",
    "pe_dup": """select * from pe union all
        select * replace (-event_id - 1 as event_id, event_ts + interval 1 minute as event_ts) from pe""",
    "raw": """select event_id, session_id,
        case when event_id % 83 = 0 then 'not-a-time' else strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') end as timestamp,
        ' ' || lower(event_type) as event_type, lower(lot_id) as lot_id,
        case when event_id % 89 = 0 then 'surrey' when event_id % 101 = 0 then 'victoria' else lower(campus) || ' ' end as campus,
        student_id, case when event_id % 97 = 0 then '' else plate_number end as plate_number,
        cast(event_ts as date) as date from parked""",
    "named": """select * replace (upper(trim(event_type)) as event_type, upper(trim(lot_id)) as lot_id,
        upper(trim(campus)) as campus), try_cast(replace(timestamp, 'Z', '') as timestamp) as event_ts from raw""",
    "checked": f"""select *, case when plate_number = '' then 'missing:plate_number'
        when event_type not in ('ARRIVAL', 'DEPARTURE') then 'event_type'
        when campus not in ('BURNABY', 'SURREY') then 'campus'
        when not ((campus = 'BURNABY' and lot_id in ('NORTH','EAST','CENTRAL','WEST','SOUTH'))
               or (campus = 'SURREY' and lot_id in ('SRYC','SRYE'))) then 'lot'
        when event_ts is null or event_ts > timestamp '{AS_OF}' + interval 1 minute then 'timestamp' end as reason from named""",
    "valid": "select * exclude (reason) from checked where reason is null",
    "capacity": """select * from (values ('BURNABY','NORTH',20), ('BURNABY','EAST',15), ('BURNABY','CENTRAL',6),
        ('BURNABY','WEST',5), ('BURNABY','SOUTH',4), ('SURREY','SRYC',5), ('SURREY','SRYE',5)) t(campus, lot_id, capacity)""",
    "pairs": """select a.session_id, a.event_ts as arrival_ts, d.departure_ts, a.event_id as arrival_id, a.lot_id, a.campus,
        a.student_id, a.plate_number, a.date from valid a left join
        (select session_id, min(event_ts) as departure_ts from valid where event_type = 'DEPARTURE' group by 1) d
        using (session_id) where a.event_type = 'ARRIVAL'""",
    "closed": "select * replace (coalesce(departure_ts, arrival_ts + interval 4 hours) as departure_ts) from pairs",
    "clean": """select session_id, 'ARRIVAL' as event_type, arrival_ts as event_ts, lot_id, campus, student_id, plate_number, date from closed
        union all select session_id, 'DEPARTURE', departure_ts, lot_id, campus, student_id, plate_number, date from closed""",
    "durations": """select session_id, cast(floor(epoch(d)) - floor(epoch(a)) as bigint) as duration_seconds from
        (select session_id, max(case when event_type = 'ARRIVAL' then event_ts end) as a,
            max(case when event_type = 'DEPARTURE' then event_ts end) as d from clean group by 1)
        where a is not null and d is not null""",
    "running": """select *, cast(sum(case when event_type = 'ARRIVAL' then 1 else -1 end)
        over (partition by lot_id, date order by event_ts) as bigint) as occ from clean""",
    "hours": """select r.lot_id, strftime(r.date, '%a') as day_of_week, hour(r.event_ts) as hour_of_day,
        cast(sum(d.duration_seconds) as double) / cast(count(d.duration_seconds) as double) / cast(60 as double) as average_duration_minutes,
        cast(sum(r.occ) as double) / cast(count(*) as double) as average_occupancy_lot,
        max(r.occ) as max_occupancy_hourly, max(c.capacity) as lot_capacity
        from running r left join durations d using (session_id) left join capacity c on c.lot_id = r.lot_id group by 1, 2, 3""",
    "history": """select lot_id, day_of_week, hour_of_day, average_occupancy_lot, average_duration_minutes,
        case when cast(max_occupancy_hourly as double) / lot_capacity >= cast(0.8 as double) then 1 else 0 end as peak_spikes_count from hours""",
    "histdays": f"""select date, {_flag_columns('date')} from
        (select distinct date from pe where event_ts < timestamp '{SWITCH}')""",
    "unified": f"""select p.session_id, p.event_ts, p.lot_id, p.campus, p.event_type, cast(p.student_id as int) as student_id,
        case when p.event_ts < timestamp '{SWITCH}' then null else p.plate_number end as plate_number,
        h.is_holiday, h.is_weekend, h.is_exam_week, h.is_first_2_weeks, h.is_special_day, p.date, p.event_id
        from pe p left join histdays h using (date)""",
    "stated": """select *, sum(case when event_type = 'ARRIVAL' then 1 else -1 end) over (partition by lot_id, date
        order by event_ts, event_id rows unbounded preceding) as occ, time_bucket(interval 15 minutes, event_ts) as w from unified""",
    "cells": """select lot_id, campus, w, max_by(occ, row(event_ts, event_id)) as occ,
        count(*) filter (where event_type = 'DEPARTURE') as dep,
        max_by(is_exam_week, row(event_ts, event_id)) filter (where is_exam_week is not null) as exam from stated group by 1, 2, 3""",
    "skeleton": """select * from (select distinct lot_id, campus from cells) l cross join
        (select unnest(generate_series(a, b, interval 15 minutes)) as w from (select min(w) as a, max(w) as b from cells)) t""",
    "filled": """select s.lot_id, s.campus, s.w,
        cast(coalesce(last_value(c.occ ignore nulls) over g, 0) as bigint) as occ,
        last_value(c.exam ignore nulls) over g as exam, coalesce(c.dep, 0) as dep
        from skeleton s left join cells c on c.lot_id = s.lot_id and c.campus = s.campus and c.w = s.w
        window g as (partition by s.lot_id, s.campus order by s.w rows between unbounded preceding and current row)""",
    "features": f"""select f.lot_id, f.campus, f.w as timestamp, f.occ as occupancy_now, dayofweek(f.w) + 1 as day_of_week,
        hour(f.w) as hour_of_day, cast(f.w as date) in {days(HOLIDAYS)} as is_holiday, dayofweek(f.w) in (0, 6) as is_weekend,
        f.exam as is_exam_week, coalesce(n.occ, 0) as occupancy_plus_15m, f.dep as departures_in_15m
        from filled f left join filled n on n.lot_id = f.lot_id and n.campus = f.campus and n.w = f.w + interval 15 minutes""",
    "steps": """select lot_id, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d,
        max(event_ts) as last_updated_ts from pe group by 1""",
    "current": """select s.lot_id, c.campus as campus_name, c.capacity,
        list_reduce(s.d, lambda a, x: greatest(0, least(c.capacity, a + x)), 0) as current_occupancy, s.last_updated_ts
        from steps s join capacity c using (lot_id)""",
    "snapshot": """select lot_id, campus_name, capacity, current_occupancy, capacity - current_occupancy as free_spots,
        cast(current_occupancy as double) / cast(capacity as double) as occupancy_rate, last_updated_ts from current""",
    "recent": """select event_id, lot_id, campus as campus_name, event_type, event_ts as event_timestamp from pe
        qualify row_number() over (partition by lot_id order by event_ts desc, event_id desc) <= 5""",
    "forecasts": """select f.lot_id, f.timestamp + interval 15 minutes as forecast_time, f.timestamp as run_time,
        greatest(0, least(f.occupancy_now, c.capacity)) as predicted_occupancy_count,
        f.departures_in_15m as predicted_num_departures,
        cast(round_even(cast(greatest(0, least(f.occupancy_now, c.capacity)) as double) / c.capacity, 2) as double) as predicted_occupancy_pct
        from features f join capacity c using (lot_id)""",
    "template": """select cast(c_custkey as varchar) as student_id,
        case when c_custkey % 10 = 0 then 'SURREY' else 'BURNABY' end as campus, c_custkey % 5 + 1 as weekday,
        (['M','T','W','Th','F'])[c_custkey % 5 + 1] as day, (8 + c_custkey % 9) * 60 + 30 as start_time,
        (8 + c_custkey % 9) * 60 + 30 + (c_custkey % 2 + 1) * 60 as end_time from customer""",
}


def with_tables(body: str) -> str:
    """``body`` preceded by the shared tables it uses, directly or through each other."""
    wanted: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in TABLES:
            if name not in wanted and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                wanted.add(name)
                pending.append(TABLES[name])
    parts = [f"{name} as ({TABLES[name]})" for name in TABLES if name in wanted]
    return f"with {', '.join(parts)} {body}" if parts else body


def outward(table: DataFrame) -> DataFrame:
    """Types that read the same in both engines: times without zone, dates and flags as text."""
    columns = []
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.DateType, T.BooleanType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return table.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(given) -> DataFrame`` under ``name`` with the SQL that must give the same rows."""

    def register(fn: Callable[[Given], DataFrame]) -> Callable[[Given], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return outward(fn(Given(prepare(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
