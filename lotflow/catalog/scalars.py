"""Scalar functions: clamps, ratios, rounding, labels and text."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.functions import numbers as N
from lotflow.functions import text as X
from lotflow.functions import timeparts as P
from lotflow.operators import serving
from lotflow.schemas import WIRE


@query("minutes_between", """select session_id, (cast(floor(epoch(departure_ts)) as bigint) - cast(floor(epoch(arrival_ts)) as bigint))
    / cast(60 as double) as minutes from closed""")
def _(g):
    from lotflow.operators.sessions import close_sessions, pair_sessions

    pairs = close_sessions(pair_sessions(g.valid))
    return pairs.select("session_id", P.minutes_between(F.col("arrival_ts"), F.col("departure_ts")).alias("minutes"))


@query("conditional_fill", """select event_id, case when event_type = 'ARRIVAL' then 'in' else 'out' end as side,
    coalesce(try_cast(replace(timestamp, 'Z', '') as timestamp), cast(date as timestamp)) as best_ts from named""")
def _(g):
    from lotflow.operators.validate import parse_strict, standardise_names

    timed = parse_strict(standardise_names(g.raw))
    return timed.select("event_id", F.when(F.col("event_type") == "ARRIVAL", "in").otherwise("out").alias("side"),
                        F.coalesce("event_ts", F.col("date").cast("timestamp")).alias("best_ts"))


@query("clamp_values", "select event_id, greatest(0, least(60, value)) as clamped from events")
def _(g):
    return g.table("events").select("event_id", N.clamp(F.col("value"), F.lit(0.0), F.lit(60.0)).alias("clamped"))


@query("occupancy_ratios", """select lot_id, timestamp, cast(occupancy_now as double) / cast(capacity as double) as occupancy_rate,
    capacity - occupancy_now as free_spots from features join capacity using (lot_id)""")
def _(g):
    rows = g.stored("features").join(g.capacity.select("lot_id", "capacity"), "lot_id")
    occupied, capacity = F.col("occupancy_now"), F.col("capacity")
    return rows.select("lot_id", "timestamp", N.occupancy_rate(occupied, capacity).alias("occupancy_rate"),
                       N.free_spots(occupied, capacity).alias("free_spots"))


@query("occupancy_rate_pct", """select lot_id, timestamp, cast(round_even(cast(occupancy_now as double) / cast(capacity as double)
    * cast(100 as double), 2) as double) as occupancy_rate_pct from features join capacity using (lot_id)""")
def _(g):
    rows = g.stored("features").join(g.capacity.select("lot_id", "capacity"), "lot_id")
    rate = N.occupancy_rate(F.col("occupancy_now"), F.col("capacity"))
    return rows.select("lot_id", "timestamp", N.rate_pct(rate).alias("occupancy_rate_pct"))


@query("round_predictions", """select event_id, greatest(0, least(60, cast(round_even(value, 0) as bigint))) as predicted,
    cast(round_even(cast(greatest(0, least(60, cast(round_even(value, 0) as bigint))) as double) / cast(60 as double), 2) as double) as share,
    0.0::double as share_of_none from events""")
def _(g):
    count = N.predicted_count(F.col("value"), F.lit(60))
    return g.table("events").select("event_id", count.alias("predicted"), N.predicted_share(count, F.lit(60)).alias("share"),
                                    N.predicted_share(count, F.lit(0)).alias("share_of_none"))


@query("hour_label", "select lot_id, day_of_week, hour_of_day, printf('%02d:00', hour_of_day) as label from history")
def _(g):
    return g.stored("history").select("lot_id", "day_of_week", "hour_of_day", X.hour_label(F.col("hour_of_day")).alias("label"))


@query("event_time_text", "select event_id, strftime(event_ts, '%Y-%m-%d') as date, strftime(event_ts, '%H:%M:%S') as time from ev")
def _(g):
    return g.ev.select("event_id", X.date_text(F.col("event_ts")).alias("date"), X.time_text(F.col("event_ts")).alias("time"))


PCT = "case when capacity > 0 then greatest(cast(0 as double), least(cast(100 as double), occupancy_now * cast(100 as double) / cast(capacity as double))) else 0 end"


@query("occupancy_judgement", f"""select lot_id, timestamp, pct, case when pct = 100 then 'FULL' when pct >= 90 then 'ALMOST FULL'
    when pct >= 70 then 'BUSY' when pct >= 40 then 'MODERATE' when pct >= 10 then 'LIGHT' when pct > 0 then 'VERY LIGHT' else 'EMPTY' end as judgement
    from (select lot_id, timestamp, {PCT} as pct from features join capacity using (lot_id))""")
def _(g):
    rows = g.stored("features").join(g.capacity.select("lot_id", "capacity"), "lot_id")
    pct = N.fill_pct(F.col("occupancy_now"), F.col("capacity"))
    return rows.select("lot_id", "timestamp", pct.alias("pct"), N.judgement(pct).alias("judgement"))


@query("availability", """select lot_id, greatest(capacity - current_occupancy, 0) as available,
    current_occupancy * cast(100 as double) / cast(capacity as double) as pct, case when current_occupancy = capacity then 'FULL'
    when current_occupancy >= 0.9 * capacity then 'ALMOST FULL' when current_occupancy >= 0.7 * capacity then 'BUSY'
    when current_occupancy >= 0.4 * capacity then 'MODERATE' when current_occupancy >= 0.1 * capacity then 'LIGHT'
    when current_occupancy > 0 then 'VERY LIGHT' else 'EMPTY' end as judgement from current""")
def _(g):
    return serving.live_status(g.stored("current"))


@query("display_text", """select lot_id, day_of_week, hour_of_day, (m // 60) || 'h ' || (m % 60) || 'm' as stay,
    cast(floor(average_occupancy_lot + 0.5) as bigint) || '%' as occupancy, greatest(cast(0 as double), least(cast(100 as double), average_occupancy_lot)) as chart_value
    from (select *, cast(floor(coalesce(average_duration_minutes, 0) + 0.5) as bigint) as m from history)""")
def _(g):
    return g.stored("history").select(
        "lot_id", "day_of_week", "hour_of_day", X.stay_text(F.col("average_duration_minutes")).alias("stay"),
        X.pct_text(F.col("average_occupancy_lot")).alias("occupancy"),
        N.clamp(F.col("average_occupancy_lot"), F.lit(0.0), F.lit(100.0)).alias("chart_value"),
    )


@query("campus_case", "select event_id, upper(trim(campus)) as upper_key, lower(trim(campus)) as lower_key from raw")
def _(g):
    return g.raw.select("event_id", X.standard_name(F.col("campus")).alias("upper_key"),
                        F.lower(F.trim("campus")).alias("lower_key"))


@query("text_patterns", """select event_id, regexp_extract('raw/' || lot_id || '/' || strftime(date, '%Y-%m-%d') || '/part', '/(\\d{4}-\\d{2}-\\d{2})/', 1) as day,
    replace(timestamp, 'Z', '+00:00') as offset_text from raw""")
def _(g):
    path = F.concat(F.lit("raw/"), F.col("lot_id"), F.lit("/"), F.date_format("date", "yyyy-MM-dd"), F.lit("/part"))
    return g.raw.select("event_id", X.day_in_path(path).alias("day"),
                        X.zulu_to_offset(F.col("timestamp")).alias("offset_text"))


@query("json_roundtrip", """select event_id, session_id, timestamp, event_type, lot_id, campus, student_id, plate_number,
    '{"session_id":"' || session_id || '","lot_id":"' || lot_id || '"}' as record from raw""")
def _(g):
    sent = g.raw.select("event_id", X.encode_record(*WIRE.fieldNames()).alias("data"))
    back = sent.withColumn("r", X.decode_record(F.col("data"), WIRE)).select("event_id", "r.*").drop("_corrupt")
    return back.withColumn("record", X.to_record("session_id", "lot_id"))


@query("peak_ratio", "select lot_id, day_of_week, hour_of_day, cast(max_occupancy_hourly as double) / cast(lot_capacity as double) as ratio from hours")
def _(g):
    return g.stored("hours").select("lot_id", "day_of_week", "hour_of_day",
                          N.peak_ratio(F.col("max_occupancy_hourly"), F.col("lot_capacity")).alias("ratio"))
