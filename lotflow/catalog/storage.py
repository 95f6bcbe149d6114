"""Sources and sinks, each written to shared scratch space and read back."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.domain import MODEL_FEATURES
from lotflow.functions.text import encode_record
from lotflow.operators.merge import merge_history
from lotflow.operators.calendar import FLAG_NAMES
from lotflow.plans.forecast import CAMPUSES, LOTS, in_training, model_matrix, row_key
from lotflow.plans.nightly import clean_log, stored_history
from lotflow.schemas import HISTORICAL, HISTORY, WIRE
from lotflow.session import shared_dir
from lotflow.sources import events as E
from lotflow.sources import sinks as K
from lotflow.sources import versions as R

def landed(g) -> str:
    tidy = g.raw.withColumn("lot_id", F.upper("lot_id"))
    return g.once("landed", lambda path: K.write_landed(tidy.select(*WIRE.fieldNames(), "date"), path))


def cleaned(g) -> str:
    return g.once("cleaned", lambda path: K.write_clean(g.clean, path))


def exported(g) -> str:
    rows = g.historical.select(*HISTORICAL.fieldNames())
    return g.once("export", lambda path: K.write_export(rows, path))


@query("scan_day", "select session_id, timestamp, event_type, upper(lot_id) as lot_id, campus from raw where date = date '2024-01-17'")
def _(g):
    return E.scan_day(g.spark, landed(g), "2024-01-17").select("session_id", "timestamp", "event_type", "lot_id", "campus")


@query("scan_partition_filtered", """select session_id, event_type, event_ts, lot_id, student_id, plate_number, campus, cast(date as varchar) as date
    from clean where date = date '2024-01-17'""")
def _(g):
    return E.scan_clean_day(g.spark, cleaned(g), "2024-01-17")


@query("empty_guard", "select 'missing folder' as source, 0 as n union all select 'landed day', count(*) from raw where date = date '2024-01-17'")
def _(g):
    missing = E.read_or_empty(g.spark, landed(g) + "-none", WIRE).agg(F.count(F.lit(1)).alias("n"))
    there = E.scan_day(g.spark, landed(g), "2024-01-17").agg(F.count(F.lit(1)).alias("n"))
    return missing.select(F.lit("missing folder").alias("source"), "n").unionByName(
        there.select(F.lit("landed day").alias("source"), "n"))


@query("partition_exists", """select '2024-01-17' as day, cast(count(*) > 0 as varchar) as found from clean where date = date '2024-01-17'
    union all select '2025-01-01', cast(count(*) > 0 as varchar) from clean where date = date '2025-01-01'""")
def _(g):
    rows = E.read_or_empty(g.spark, cleaned(g), E.CLEAN)
    parts = [E.has_day(rows, day).select(F.lit(day).alias("day"), "found") for day in ("2024-01-17", "2025-01-01")]
    return parts[0].unionByName(parts[1])


@query("scan_realtime", "select session_id, timestamp, event_type, upper(lot_id) as lot_id, campus, student_id, plate_number from raw")
def _(g):
    return E.scan_realtime(g.spark, landed(g))


@query("date_from_path", "select session_id, event_type, cast(date as varchar) as date from raw")
def _(g):
    return E.with_path_day(E.scan_realtime(g.spark, landed(g))).select("session_id", "event_type", "date")


@query("csv_to_parquet", """select session_id, event_ts as timestamp, cast(student_id as int) as student_id, upper(campus) as campus,
    cast(date as varchar) as date, cast(is_holiday as varchar) as is_holiday, cast(is_weekend as varchar) as is_weekend,
    cast(is_exam_week as varchar) as is_exam_week, cast(is_first_2_weeks as varchar) as is_first_2_weeks,
    cast(is_special_day as varchar) as is_special_day from pe join histdays using (date)
    where event_ts < timestamp '2024-01-23 12:00:00'""")
def _(g):
    path = g.once("historical", lambda p: K.convert_export(E.read_export(g.spark, exported(g)), p))
    rows = E.scan_historical(g.spark, path)
    return rows.select("session_id", F.col("event_ts").alias("timestamp"), "student_id", "campus", "date", *FLAG_NAMES)


@query("scan_historical", """select session_id, event_ts, lot_id, campus, event_type, cast(student_id as int) as student_id
    from pe where event_ts < timestamp '2024-01-23 12:00:00'""")
def _(g):
    path = g.once("historical", lambda p: K.convert_export(E.read_export(g.spark, exported(g)), p))
    return E.scan_historical(g.spark, path).select("session_id", "event_ts", "lot_id", "campus", "event_type", "student_id")


@query("land_events", "select session_id, timestamp, event_type, upper(lot_id) as lot_id, campus, cast(date as varchar) as date from raw")
def _(g):
    return g.spark.read.schema(E.LANDED).parquet(landed(g)).select("session_id", "timestamp", "event_type", "lot_id", "campus", "date")


@query("decode_events", """select event_id, case when event_id % 83 = 0 then null else session_id end as session_id,
    case when event_id % 83 = 0 then null else timestamp end as timestamp, cast(event_id % 83 = 0 as varchar) as bad from raw""")
def _(g):
    broken = F.col("timestamp") == "not-a-time"
    data = F.when(broken, F.lit("{not json")).otherwise(encode_record(*WIRE.fieldNames()))
    records = g.raw.select("event_id", data.alias("data"))
    decoded = E.decode_events(records)
    return decoded.select("event_id", "session_id", "timestamp", F.col("_corrupt").isNotNull().alias("bad"))


@query("write_clean", "select session_id, event_type, event_ts, lot_id, campus, cast(date as varchar) as date from clean")
def _(g):
    path = shared_dir(g.spark, "clean")
    K.write_clean(g.clean, path)
    # Writing one day again replaces that day only.
    K.write_clean(g.clean.filter(F.col("date") == F.lit("2024-01-17").cast("date")), path)
    back = E.read_or_empty(g.spark, path, E.CLEAN)
    return back.select("session_id", "event_type", "event_ts", "lot_id", "campus", "date")


@query("nightly_clean", "select session_id, event_type, event_ts, lot_id from clean")
def _(g):
    from lotflow.operators.validate import accepted

    return clean_log(accepted(g.checked).drop("event_ts")).select("session_id", "event_type", "event_ts", "lot_id")


@query("write_training_set", """select lot_id, campus, timestamp, occupancy_now, day_of_week, hour_of_day, cast(is_holiday as varchar) as is_holiday,
    cast(is_weekend as varchar) as is_weekend, cast(is_exam_week as varchar) as is_exam_week, occupancy_plus_15m, departures_in_15m from features""")
def _(g):
    path = shared_dir(g.spark, "training")
    features = g.features
    K.write_training_set(features, path)
    return g.spark.read.schema(features.schema).parquet(path)


@query("publish_validated", """select lot_id as key, '{"session_id":"' || session_id || '","event_type":"' || event_type || '","lot_id":"' || lot_id ||
    '","campus":"' || campus || '"}' as value from valid""")
def _(g):
    return K.to_stream_records(g.valid, "session_id", "event_type", "lot_id", "campus")


@query("stage_then_merge", """select lot_id, day_of_week, hour_of_day, cast(round(average_occupancy_lot, 4) as double) as average_occupancy_lot,
    cast(cast(cast(average_duration_minutes as varchar) as decimal(10, 2)) as double) as average_duration_minutes, peak_spikes_count from history""")
def _(g):
    staging, root = shared_dir(g.spark, "staging"), shared_dir(g.spark, "history")
    new = stored_history(g.stored("history"))
    new.write.mode("overwrite").parquet(staging)
    staged = g.spark.read.schema(new.schema).parquet(staging)
    # The second merge replaces every row by itself.
    for _ in range(2):
        R.add_version(merge_history(R.read_latest(g.spark, root, HISTORY), staged), root)
    return R.read_latest(g.spark, root, HISTORY)


@query("declare_table", """select lot_id, day_of_week, hour_of_day, cast(round(average_occupancy_lot, 4) as double) as average_occupancy_lot,
    cast(cast(cast(average_duration_minutes as varchar) as decimal(10, 2)) as double) as average_duration_minutes, peak_spikes_count from history""")
def _(g):
    location = shared_dir(g.spark, "metrics")
    name = "hourly_" + location[-8:]
    R.declare_table(g.spark, name, HISTORY, location)
    R.declare_table(g.spark, name, HISTORY, location)
    stored_history(g.stored("history")).write.insertInto(name)
    return g.spark.table(name)


LOT_SQL = ", ".join([f"cast(lot_id = '{v}' as int) as lot_id_{v}" for v in LOTS] + [f"cast(campus = '{v}' as int) as campus_{v}" for v in CAMPUSES])


@query("export_training_csv", f"""select occupancy_plus_15m as label, occupancy_now, day_of_week, hour_of_day, cast(is_holiday as int) as is_holiday,
    cast(is_weekend as int) as is_weekend, cast(coalesce(is_exam_week, false) as int) as is_exam_week, {LOT_SQL} from features where
    substr(md5(lot_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M')), 1, 4) < 'cccd'""")
def _(g):
    path = shared_dir(g.spark, "csv")
    rows = model_matrix(g.stored("features")).filter(in_training(row_key()))
    K.export_training_csv(rows, "occupancy_plus_15m", MODEL_FEATURES, path)
    names = ["label", *MODEL_FEATURES]
    return g.spark.read.schema(", ".join(f"{n} bigint" for n in names)).csv(path)


@query("dim_capacity", "select t.campus, t.lot_id, t.capacity, count(p.event_id) as n_events from capacity t left join ev p using (lot_id) group by all")
def _(g):
    counts = g.ev.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_events"))
    return g.capacity.join(counts, "lot_id", "left").fillna(0, subset=["n_events"]).select("campus", "lot_id", "capacity", "n_events")


@query("read_current_state", "select lot_id, campus_name, current_occupancy, capacity from current")
def _(g):
    root = shared_dir(g.spark, "current")
    snapshot = g.current
    R.add_version(snapshot, root)
    return R.read_latest(g.spark, root, snapshot.schema).select("lot_id", "campus_name", "current_occupancy", "capacity")
