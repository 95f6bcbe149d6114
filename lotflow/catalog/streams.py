"""Streaming jobs run to the end of a set of files, with the state they leave behind."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.fixtures import AS_OF
from lotflow.functions.text import encode_record
from lotflow.schemas import CURRENT, RECENT, WIRE
from lotflow.session import shared_dir
from lotflow.sources.versions import read_latest
from lotflow.streaming import days as Y
from lotflow.streaming import jobs as J
from lotflow.streaming.replay import failed_positions, send_again


#: Files of a batch: four batches in a month of records.
LIVE_FILES = 64


#: What the landed folders hold, whole.
LANDED_TYPES = {"event_id": "bigint", **{c: "string" for c in WIRE.fieldNames()}, "date": "date"}


def _write_in_order(g, rows, path: str, *fields) -> None:
    """Packed JSON files of ``fields``, a folder per ``slot``, with file times in order of the slots so that a stream reads them in that order.

    ``fields`` are made of the rows once these are in their slots, so long texts are never moved.
    """
    placed = rows.repartition("slot").sortWithinPartitions("slot", "event_id")
    placed.select(*fields, "slot").write.option("compression", "gzip").partitionBy("slot").json(path)
    jvm = g.spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(g.spark._jsc.hadoopConfiguration())
    slots = sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory())
    for i, slot in enumerate(slots):
        for part in fs.listStatus(jvm.Path(slot)):
            fs.setTimes(part.getPath(), 1_700_000_000_000 + i * 60_000, -1)


def _slot():
    """A quarter of a day; records without a readable time go to their day's first."""
    hour = F.coalesce(F.substring("timestamp", 12, 2).try_cast("int"), F.lit(0))
    return F.concat_ws("-", F.date_format("date", "yyyyMMdd"), F.floor(hour / 6).cast("string"))


def day_files(g) -> str:
    """Raw records as JSON, a file per quarter of a day."""
    return g.once("records", lambda path: _write_in_order(
        g, g.raw.select(*WIRE.fieldNames(), "event_id", _slot().alias("slot")), path, *WIRE.fieldNames(), "event_id"))


def _records(g):
    return J.read_records(g.spark, day_files(g), files_per_batch=LIVE_FILES // 2)


def _dirs(g, *names: str) -> list[str]:
    root = shared_dir(g.spark, "stream")
    return [f"{root}/{n}" for n in names]


def sent_files(g) -> str:
    """The raw records as sent: base64 JSON, one in 79 of them sent a second time in a file of its own, one in 211 broken."""

    def write(path: str) -> None:
        data = F.when(F.col("event_id") % 211 == 0, F.concat(F.lit("{not json "), F.col("event_id").cast("string"))).otherwise(
            encode_record(*WIRE.fieldNames()))
        sent = F.when(F.col("event_id") % 79 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a")))
        rows = g.raw.select("event_id", *WIRE.fieldNames(), _slot().alias("at"), F.explode(sent).alias("part"))
        _write_in_order(g, rows.withColumn("slot", F.concat_ws("-", "at", "part")).drop("at", "part"), path, "event_id", data.alias("data"))

    return g.once("sent", write)


@query("stream_validate", """select why as reason, text, sum(times) as n from (select case when event_id % 211 = 0 then 'bad_json'
        else coalesce(reason, 'ok') end as why, case when event_id % 211 = 0 then '{not json ' || event_id end as text,
        case when event_id % 79 = 0 then 2 else 1 end as times from checked) group by 1, 2""")
def _(g):
    good, bad, checkpoint = _dirs(g, "good", "bad", "checkpoint")
    J.split_valid(J.read_sent(g.spark, sent_files(g), LIVE_FILES), AS_OF, good, bad, checkpoint).awaitTermination()
    accepted = g.spark.read.parquet(good).select(F.lit("ok").alias("reason"), F.lit(None).cast("string").alias("text"))
    rejected = g.spark.read.parquet(bad).select("reason", F.col("_corrupt").alias("text"))
    return accepted.unionByName(rejected).groupBy("reason", "text").agg(F.count(F.lit(1)).alias("n"))


@query("stream_live", """select 'current' as part, lot_id, cast(current_occupancy as bigint) as a, cast(free_spots as bigint) as b, strftime(last_updated_ts, '%Y-%m-%d %H:%M:%S.%f') as c
    from (select s.lot_id, list_reduce(s.d, lambda a, x: greatest(0, least(c.capacity, a + x)), 0) as current_occupancy,
        c.capacity - list_reduce(s.d, lambda a, x: greatest(0, least(c.capacity, a + x)), 0) as free_spots, s.last_updated_ts
        from (select lot_id, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d, max(event_ts) as last_updated_ts
            from valid where event_id % 211 <> 0 group by 1) s join capacity c using (lot_id))
    union all select 'recent', lot_id, event_id, 0, strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') from (select * from valid where event_id % 211 <> 0)
        qualify row_number() over (partition by lot_id order by event_ts desc, event_id desc) <= 5
    union all select 'counts', '', sum(case when event_id % 211 <> 0 and reason is null then times else 0 end)::bigint,
        sum(case when event_id % 211 = 0 or reason is not null then times else 0 end)::bigint, ''
        from (select *, case when event_id % 79 = 0 then 2 else 1 end as times from checked)""")
def _(g):
    """The live job over all records as sent, in several batches in order of time; those sent again count once."""
    root, checkpoint = _dirs(g, "live", "checkpoint")
    records = J.read_sent(g.spark, sent_files(g), files_per_batch=LIVE_FILES)
    J.live(records, g.capacity, AS_OF, root, checkpoint).awaitTermination()
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("c")
    current = read_latest(g.spark, f"{root}/current", CURRENT).select(
        F.lit("current").alias("part"), "lot_id", F.col("current_occupancy").alias("a"), F.col("free_spots").alias("b"), at("last_updated_ts"))
    recent = read_latest(g.spark, f"{root}/recent", RECENT).select(
        F.lit("recent").alias("part"), "lot_id", F.col("event_id").alias("a"), F.lit(0).cast("bigint").alias("b"), at("event_timestamp"))
    counts = g.spark.read.schema(J.COUNTS).parquet(f"{root}/counts").agg(F.sum("processed").alias("a"), F.sum("failed").alias("b")).select(
        F.lit("counts").alias("part"), F.lit("").alias("lot_id"), "a", "b", F.lit("").alias("c"))
    return current.unionByName(recent).unionByName(counts)


@query("replay_failed", """select event_id, case when event_id % 211 = 0 then 'bad_json' else reason end as first_reasons,
        case when event_id % 79 = 0 then 2 else 1 end as first_attempts, case when reason is not null and event_id % 211 = 0
        then least('bad_json', reason) || ',' || greatest('bad_json', reason) else reason end as last_reasons,
        case when reason is null then 1 else 0 end as counted from checked where event_id % 211 = 0 or reason is not null""")
def _(g):
    """Every position that failed in the live job, sent again whole: still failing or counted, and how often."""
    root, again, first, second = _dirs(g, "live", "again", "first", "second")
    J.live(J.read_sent(g.spark, sent_files(g), LIVE_FILES), g.capacity, AS_OF, root, first).awaitTermination()
    listed = shared_dir(g.spark, "failed")
    failed_positions(g.spark, root).write.parquet(listed)
    failed = g.spark.read.parquet(listed)
    whole = g.raw.select("event_id", encode_record(*WIRE.fieldNames()).alias("data"))
    send_again(whole, failed, again)
    J.live(J.read_sent(g.spark, again, LIVE_FILES), g.capacity, AS_OF, root, second).awaitTermination()
    still = failed_positions(g.spark, root).select("event_id", F.array_join("reasons", ",").alias("last_reasons"))
    counted = g.spark.read.schema("event_id long").parquet(f"{root}/new").groupBy("event_id").agg(F.count(F.lit(1)).alias("counted"))
    first_failed = failed.select("event_id", F.array_join("reasons", ",").alias("first_reasons"), F.col("attempts").alias("first_attempts"))
    return first_failed.join(still, "event_id", "left").join(counted, "event_id", "left").fillna(0, ["counted"])


CURRENT_SQL = """select lot_id, campus_name, capacity, current_occupancy, capacity - current_occupancy as free_spots,
    cast(current_occupancy as double) / cast(capacity as double) as occupancy_rate, last_updated_ts from (
    select s.lot_id, c.campus as campus_name, c.capacity, list_reduce(s.d, lambda a, x: greatest(0, least(c.capacity, a + x)), 0)
    as current_occupancy, s.last_updated_ts from (select lot_id, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d,
    max(event_ts) as last_updated_ts from valid group by 1) s join capacity c using (lot_id))"""


def _current(g, events):
    root, checkpoint = _dirs(g, "current", "checkpoint")
    J.keep_current(events, g.capacity, root, checkpoint).awaitTermination()
    return read_latest(g.spark, root, CURRENT)


@query("stream_current_occupancy", CURRENT_SQL)
def _(g):
    return _current(g, J.accepted_events(_records(g), AS_OF))


@query("stream_dedup", CURRENT_SQL)
def _(g):
    # Every record is sent twice; the repeats must not count, however late they come.
    events = J.accepted_events(_records(g), AS_OF)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _current(g, J.without_repeats(twice))


@query("stream_recent_events", """select event_id, lot_id, campus as campus_name, event_type, event_ts as event_timestamp from valid
    qualify row_number() over (partition by lot_id order by event_ts desc, event_id desc) <= 5""")
def _(g):
    root, checkpoint = _dirs(g, "recent", "checkpoint")
    J.keep_recent(J.accepted_events(_records(g), AS_OF), root, checkpoint).awaitTermination()
    return read_latest(g.spark, root, RECENT)


@query("daily_reset", """select lot_id, cast(date as varchar) as date, list_reduce(d, lambda a, x: greatest(0, least(capacity, a + x)), 0) as occupancy
    from (select lot_id, date, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d from valid group by 1, 2)
    join capacity using (lot_id)""")
def _(g):
    root, checkpoint = _dirs(g, "daily", "checkpoint")
    J.keep_daily(J.accepted_events(_records(g), AS_OF), g.capacity, root, checkpoint).awaitTermination()
    return read_latest(g.spark, root, J.DAYS)


@query("daily_close", """select l.lot_id, cast(l.d as varchar) as date, coalesce(o.occupancy, 0)::bigint as occupancy,
    case when l.d < cast(l.newest as date) then 'true' else 'false' end as closed
    from (select lot_id, newest, unnest(generate_series(start, cast(newest as date), interval 1 day))::date as d
        from (select lot_id, min(date) as start, (select max(event_ts) from valid) as newest from valid group by 1)) l
    left join (select lot_id, date as d, list_reduce(d, lambda a, x: greatest(0, least(capacity, a + x)), 0) as occupancy
        from (select lot_id, date, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d from valid group by 1, 2)
        join capacity using (lot_id)) o using (lot_id, d)""")
def _(g):
    """Days closed by timers: every lot has every day from its first to the newest event's, silent ones at 0."""
    root, folding, closing = _dirs(g, "days", "fold", "close")
    Y.fold_days(J.accepted_events(_records(g), AS_OF), g.capacity, root, folding).awaitTermination()
    Y.close_days(g.spark, root, closing).awaitTermination()
    return Y.read_days(g.spark, root)


@query("stream_land", """select event_id, session_id, timestamp, event_type, lot_id, campus, student_id, plate_number,
    cast(case when event_id % 83 > 0 then date end as varchar) as date from raw""")
def _(g):
    path, checkpoint = _dirs(g, "landed", "checkpoint")
    J.land(_records(g), path, checkpoint).awaitTermination()
    return g.spark.read.schema(", ".join(f"{c} {t}" for c, t in LANDED_TYPES.items())).parquet(path)


@query("stream_window_15m", """select lot_id, time_bucket(interval 15 minutes, event_ts) as window_start, count(*) as departures_in_15m
    from valid where event_type = 'DEPARTURE' group by 1, 2""")
def _(g):
    root, checkpoint = _dirs(g, "windows", "checkpoint")
    J.count_windows(J.accepted_events(_records(g), AS_OF), root, checkpoint).awaitTermination()
    J.reconcile_windows(g.spark, root)
    return J.read_windows(g.spark, root)


@query("batch_metrics", """select sum(times) filter (where ok)::bigint as processed, sum(times) filter (where not ok)::bigint as failed,
    sum(times) filter (where bad or lot_id is null or lot_id not in ('NORTH','EAST','CENTRAL','WEST','SOUTH','SRYC','SRYE'))::bigint as unknown_lot
    from (select lot_id, event_id % 211 = 0 as bad, event_id % 211 <> 0 and reason is null as ok, case when event_id % 79 = 0 then 2 else 1 end as times from checked)""")
def _(g):
    root, checkpoint = _dirs(g, "metrics", "checkpoint")
    J.count_batches(J.read_sent(g.spark, sent_files(g), LIVE_FILES), AS_OF, root, checkpoint).awaitTermination()
    batches = g.spark.read.schema(J.COUNTS).parquet(f"{root}/counts")
    return batches.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.sum("unknown_lot").alias("unknown_lot"))
