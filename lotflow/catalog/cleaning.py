"""Projections, filters, checks and cleaning."""

from pyspark.sql import functions as F

from lotflow.catalog.base import days, query
from lotflow.domain import REQUIRED
from lotflow.fixtures import AS_OF, HOLIDAYS
from lotflow.functions.numbers import event_delta
from lotflow.functions.timeparts import end_of_day, iso_ts, local_time, previous_local_day, shift, strict_ts
from lotflow.operators import validate as V
from lotflow.operators.calendar import off_day
from lotflow.sources.events import unify_historical, unify_realtime


@query("select_expected", "select session_id, timestamp, event_type, lot_id, campus, student_id, plate_number from raw")
def _(g):
    return g.raw.select(*REQUIRED)


@query("require_fields", """select event_id, case when plate_number = '' then 'missing:plate_number' end as missing from raw""")
def _(g):
    return g.raw.select("event_id", V.missing_field().alias("missing"))


@query("standardise_names", """select event_id, upper(trim(event_type)) as event_type, upper(trim(lot_id)) as lot_id,
    upper(trim(campus)) as campus from raw""")
def _(g):
    return V.standardise_names(g.raw).select("event_id", "event_type", "lot_id", "campus")


@query("cast_ids", "select event_id, student_id, cast(student_id as int) as student_no, try_cast(plate_number as int) is null as not_a_number from raw")
def _(g):
    return g.raw.select("event_id", F.col("student_id").cast("string").alias("student_id"),
                        F.col("student_id").try_cast("int").alias("student_no"),
                        F.col("plate_number").try_cast("int").isNull().alias("not_a_number"))


@query("check_domain", "select event_id, event_type in ('ARRIVAL','DEPARTURE') as type_ok, campus in ('BURNABY','SURREY') as campus_ok from named")
def _(g):
    named = V.standardise_names(g.raw)
    return named.select("event_id", V.known_event_type().alias("type_ok"), V.known_campus().alias("campus_ok"))


@query("check_lot_for_campus", """select event_id, lot_id, campus from named where not (
    (campus = 'BURNABY' and lot_id in ('NORTH','EAST','CENTRAL','WEST','SOUTH')) or (campus = 'SURREY' and lot_id in ('SRYC','SRYE')))""")
def _(g):
    return V.standardise_names(g.raw).filter(~V.lot_on_campus()).select("event_id", "lot_id", "campus")


@query("parse_iso_ts", "select event_id, event_ts from named")
def _(g):
    return g.raw.select("event_id", iso_ts(F.col("timestamp")).alias("event_ts"))


@query("reject_future", f"select event_id, event_ts from named where event_ts > timestamp '{AS_OF}' + interval 1 minute")
def _(g):
    timed = g.raw.withColumn("event_ts", iso_ts(F.col("timestamp")))
    late = F.col("event_ts").isNotNull() & ~V.acceptable_time(F.col("event_ts"), AS_OF)
    return timed.filter(late).select("event_id", "event_ts")


@query("validate_events", """select event_id, session_id, event_ts, event_type, lot_id, campus, student_id, plate_number from valid""")
def _(g):
    return g.valid.select("event_id", "session_id", "event_ts", "event_type", "lot_id", "campus", "student_id", "plate_number")


@query("quarantine", "select event_id, session_id, timestamp, event_type, lot_id, campus, reason from checked where reason is not null")
def _(g):
    return V.quarantined(g.checked).select("event_id", "session_id", "timestamp", "event_type", "lot_id", "campus", "reason")


@query("reasons", "select coalesce(reason, 'ok') as reason, count(*) as n from checked group by 1")
def _(g):
    return g.checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_event_type", "select event_id, session_id, event_ts from pe where event_type = 'ARRIVAL'")
def _(g):
    return V.only_types(g.pe, "ARRIVAL").select("event_id", "session_id", "event_ts")


@query("drop_null_ts", "select event_id, event_ts from named where event_ts is not null")
def _(g):
    return V.drop_untimed(V.parse_strict(g.raw)).select("event_id", "event_ts")


@query("parse_fixed_ts", "select event_id, timestamp, event_ts from named")
def _(g):
    return g.raw.select("event_id", "timestamp", strict_ts(F.col("timestamp")).alias("event_ts"))


@query("unify_schema", """select session_id, event_ts, lot_id, campus, event_type, cast(student_id as int) as student_id,
    cast(null as varchar) as plate_number, event_id, 'historical' as source from pe where event_ts < timestamp '2024-01-23 12:00:00'
    union all select session_id, event_ts, lot_id, campus, event_type, cast(student_id as int), plate_number, event_id, 'live'
    from pe where event_ts >= timestamp '2024-01-23 12:00:00'""")
def _(g):
    keep = ["session_id", "event_ts", "lot_id", "campus", "event_type", "student_id", "plate_number", "event_id"]
    old = unify_historical(g.historical).select(*keep, F.lit("historical").alias("source"))
    return old.unionByName(unify_realtime(g.live).select(*keep, F.lit("live").alias("source")))


@query("event_delta", "select event_id, case event_type when 'ARRIVAL' then 1 when 'DEPARTURE' then -1 end as delta from ev")
def _(g):
    return g.ev.select("event_id", event_delta(F.col("event_type")).alias("delta"))


@query("known_lots_only", "select event_id, n.lot_id, capacity from named n join capacity using (lot_id)")
def _(g):
    return V.known_lots(V.standardise_names(g.raw), g.capacity).select("event_id", "lot_id", "capacity")


@query("fill_zero", """select lot_id, campus, w as window_start, coalesce(occ, 0) as occupancy_now, coalesce(dep, 0) as departures
    from skeleton left join cells using (lot_id, campus, w)""")
def _(g):
    from lotflow.operators.grid import fill_grid

    grid = fill_grid(g.stored("cells")).fillna(0, subset=["occupancy_now", "departures"])
    return grid.select("lot_id", "campus", "window_start", "occupancy_now", "departures")


@query("drop_incomplete_pairs", "select session_id, arrival_ts, departure_ts from pairs where departure_ts is not null")
def _(g):
    from lotflow.operators.sessions import complete_only, pair_sessions

    return complete_only(pair_sessions(g.valid)).select("session_id", "arrival_ts", "departure_ts")


@query("cutoff_date", "select event_id, event_ts from ev where cast(event_ts as date) <= date '2024-01-20'")
def _(g):
    return g.ev.filter(F.to_date("event_ts") <= F.lit("2024-01-20").cast("date")).select("event_id", "event_ts")


@query("previous_local_day", """select event_id, cast(cast(timezone('America/Vancouver', timezone('UTC', event_ts)) as date) - 1 as varchar)
    as processing_day from ev""")
def _(g):
    return g.ev.select("event_id", previous_local_day(F.col("event_ts")).alias("processing_day"))


@query("cap_departure_at_day_end", """select session_id, arrival_ts, least(departure_ts, date_trunc('day', arrival_ts)
    + interval '23 hours 59 minutes 59 seconds') as departure_ts from closed""")
def _(g):
    from lotflow.operators.sessions import close_sessions, pair_sessions

    pairs = close_sessions(pair_sessions(g.valid))
    return pairs.select("session_id", "arrival_ts",
                        F.least("departure_ts", end_of_day(F.col("arrival_ts"))).alias("departure_ts"))


@query("off_day_split", f"""select event_id, case when dayofweek(date) in (0, 6) or date in {days(HOLIDAYS)} then 'off_day' else 'active' end
    as day_kind from ev""")
def _(g):
    kind = F.when(off_day(F.col("date"), HOLIDAYS), "off_day").otherwise("active")
    return g.ev.select("event_id", kind.alias("day_kind"))


@query("serving_filters", """select lot_id, day_of_week, hour_of_day, average_occupancy_lot, average_duration_minutes from history
    where lot_id = 'EAST' and day_of_week = 'Tue' and hour_of_day = 10""")
def _(g):
    wanted = (F.col("lot_id") == "EAST") & (F.col("day_of_week") == "Tue") & (F.col("hour_of_day") == 10)
    return g.stored("history").filter(wanted).drop("peak_spikes_count")


@query("local_time", "select event_id, timezone('America/Vancouver', timezone('UTC', event_ts)) as local_ts from ev")
def _(g):
    return g.ev.select("event_id", local_time(F.col("event_ts")).alias("local_ts"))


@query("interval_shift", """select event_id, event_ts + interval 4 hours as plus_4h, event_ts - interval 15 minutes as minus_15m,
    event_ts + interval 15 minutes as plus_15m from ev""")
def _(g):
    ts = F.col("event_ts")
    return g.ev.select("event_id", shift(ts, hours=4).alias("plus_4h"), shift(ts, minutes=-15).alias("minus_15m"),
                       shift(ts, minutes=15).alias("plus_15m"))
