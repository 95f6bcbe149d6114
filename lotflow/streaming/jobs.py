"""Live jobs over a stream of event records.

Each micro-batch goes through the same operators as the nightly jobs.  What grows with the history, the sessions counted so
far, is keyed state on disk (RocksDB), of which a batch writes its changes.  Results of one row per lot are small tables kept
as versions that know the last batch of every stream, so a batch that is run again after a failure changes nothing, and a
stream with a new checkpoint is another stream, whose batches all count.  Folders of rows are named by stream and batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotflow.domain import CAMPUS_LOTS, KEEP_PER_LOT, as_dates
from lotflow.operators.merge import add_counts, merge_current, merge_days
from lotflow.operators.occupancy import day_runs, departures_per_window, lot_runs
from lotflow.operators.serving import newest_per_lot, recent_events
from lotflow.operators.validate import accepted, validate
from lotflow.schemas import CURRENT, RECENT, WIRE
from lotflow.sources.events import decode_events, read_or_empty
from lotflow.sources.versions import _commit, exists, expire, folders, make_folder, read_small, update

#: Stream records: wire fields, the position the stream gave them, and the text of a line that can't be read.
RECORD = T.StructType([*WIRE.fields, T.StructField("event_id", T.LongType()), T.StructField("_corrupt", T.StringType())])
#: Records as the stream hands them on: base64 text and their position.
SENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("data", T.StringType())])

DAYS = T.StructType([T.StructField("lot_id", T.StringType()), T.StructField("date", T.DateType()),
                     T.StructField("occupancy", T.LongType())])
WINDOWS = T.StructType([T.StructField("lot_id", T.StringType()), T.StructField("window_start", T.TimestampType()),
                        T.StructField("departures_in_15m", T.LongType())])
COUNTS = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("processed", T.LongType()),
                       T.StructField("failed", T.LongType()), T.StructField("unknown_lot", T.LongType())])
#: How often a stream looks for what another one has landed.
FOLLOWING = "1 second"
#: What makes a record a repeat of another.
ONCE = ["session_id", "event_type"]
# State of streams on disk; a checkpoint holds the changes of a batch, not the whole state.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A state of keys alone: its number of rows is not kept, which would look every key up once more.
KEYS_ON_DISK = {**STATE_ON_DISK, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def _files(spark: SparkSession, schema: T.StructType, path: str, files_per_batch: int) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path))


def read_records(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """JSON files as a stream, oldest first; a line that can't be read is kept whole in ``_corrupt``."""
    return _files(spark, RECORD, path, files_per_batch)


def read_sent(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Files of records with base64 data, decoded; an unreadable one is kept whole in ``_corrupt``."""
    return decode_events(_files(spark, SENT, path, files_per_batch))


def checked(records: DataFrame, as_of: str) -> DataFrame:
    return validate(records, as_of)


def without_repeats(events: DataFrame) -> DataFrame:
    """Each (session, type) once, however late it comes or is sent again: the keys stay in the stream's state on disk."""
    return events.dropDuplicates(ONCE)


def _trigger(every: str | None) -> dict:
    """Run at the given interval, or once over all that is there."""
    return {"processingTime": every} if every else {"availableNow": True}


@contextmanager
def state_on_disk(spark: SparkSession, settings: dict[str, str] = STATE_ON_DISK) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _start(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None,
           settings: dict[str, str] = STATE_ON_DISK) -> StreamingQuery:
    with state_on_disk(stream.sparkSession, settings):
        return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
                .trigger(**_trigger(every)).start())


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream got with its checkpoint; a new checkpoint makes a new stream."""
    return json.loads(read_small(spark, f"{checkpoint}/metadata"))["id"]


def _batch_folder(spark: SparkSession, root: str, checkpoint: str, batch_id: int) -> str:
    return f"{root}/stream={stream_id(spark, checkpoint)}/batch={batch_id}"


def _write_split(rows: DataFrame, good: str, bad: str, seen: Observation | None = None) -> None:
    """Write accepted rows and the others; ``seen`` gets the numbers of all of them."""
    every = rows if seen is None else rows.observe(seen, *_numbers())
    every.filter(F.col("reason").isNull()).drop("reason", "_corrupt").write.mode("overwrite").parquet(good)
    rows.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(bad)


def split_valid(records: DataFrame, as_of: str, good: str, bad: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Accepted events to ``good``, the others with their reason (and the text, if unreadable) to ``bad``.

    A folder per stream and batch; a repeated batch overwrites its own folders.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            folder = lambda root: _batch_folder(batch.sparkSession, root, checkpoint, batch_id)
            _write_split(rows, folder(good), folder(bad))
        finally:
            rows.unpersist()

    return _start(checked(records, as_of), on_batch, checkpoint, every)


Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _versioned(root: str, schema: T.StructType, checkpoint: str, merge: Merge) -> Callable[[DataFrame, int], None]:
    """Apply each batch of the stream once to the stored table: ``merge(old, batch)``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        update(spark, root, schema, lambda old: merge(old, batch), (stream_id(spark, checkpoint), batch_id))
        expire(spark, root)

    return on_batch


def into_current(capacity: DataFrame) -> Merge:
    """Every batch is folded to one triple per lot and applied to the stored counts."""
    return lambda old, batch: merge_current(old, lot_runs(batch, capacity), capacity)


def into_recent(k: int = KEEP_PER_LOT) -> Merge:
    return lambda old, batch: newest_per_lot(old.unionByName(recent_events(batch, k)), "event_timestamp", k, "event_id")


def keep_current(events: DataFrame, capacity: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The live snapshot."""
    return _start(events, _versioned(root, CURRENT, checkpoint, into_current(capacity)), checkpoint, every)


def keep_recent(events: DataFrame, root: str, checkpoint: str, k: int = KEEP_PER_LOT, every: str | None = None) -> StreamingQuery:
    """The newest ``k`` events per lot."""
    return _start(events, _versioned(root, RECENT, checkpoint, into_recent(k)), checkpoint, every)


def keep_daily(events: DataFrame, capacity: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts that restart every day: the state is keyed by lot and date."""
    merge = lambda old, batch: merge_days(old, day_runs(batch, capacity))
    return _start(events, _versioned(root, DAYS, checkpoint, merge), checkpoint, every)


class LiveJob:
    """The streams of one job."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802  as of a stream
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


class ChainedJob(LiveJob):
    """A stream that ends by itself and one that follows it and ends when all that the first left behind is done."""

    def awaitTermination(self) -> None:  # noqa: N802  as of a stream
        first, following = self.queries
        try:
            first.awaitTermination()
            following.processAllAvailable()
        finally:
            self.stop()


def live(records: DataFrame, capacity: DataFrame, as_of: str, root: str, checkpoint: str, every: str | None = None) -> LiveJob:
    """The whole live path: decoded records are checked, split, kept once and merged, by two streams, the second over what the first lands.

    The first writes, below ``root``, ``bad`` (records with their reason and text, for a retry), ``landed`` (accepted records, as often as
    they were sent) and ``counts`` (per batch).  The second follows the first one's folders in ``landed``, so records are read and decoded
    once.  It lets each session and type through once and writes ``new`` (the records that count), then merges them into the tables
    ``current`` and ``recent``.  A landed batch appears whole, so a batch of the second is one or more of the first, in their order.

    A record that is sent again counts once, in whatever batch or stream it comes: the stream's keys are state on disk, and
    those of other streams (with other checkpoints) are read from ``new``.  What a batch writes depends on its records
    alone, not on the history.  Each table remembers the batches that it holds, and the rows of ``landed`` and ``new`` are written once, so a
    batch that failed half way is finished with the same rows when it is run again.  Of records of one session and type
    that differ, the first to come counts (of one batch, any).
    """
    spark, rows = records.sparkSession, checked(records, as_of)
    intake = _start(rows, _intake(root, f"{checkpoint}/intake"), f"{checkpoint}/intake", every)
    landed = f"{root}/landed/stream={stream_id(spark, f'{checkpoint}/intake')}"
    make_folder(spark, landed)
    taken = spark.readStream.schema(accepted(rows).schema).option("recursiveFileLookup", "true").parquet(landed)
    once = _start(without_repeats(taken), _count_once(capacity, root, f"{checkpoint}/once"), f"{checkpoint}/once", every or FOLLOWING,
                  KEYS_ON_DISK)
    return LiveJob(intake, once) if every else ChainedJob(intake, once)


def _intake(root: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = lambda kind: _batch_folder(spark, f"{root}/{kind}", checkpoint, batch_id)
        if exists(spark, folder("landed")):
            return
        # What another stream follows comes last and whole.
        staged = f"{folder('landed').rsplit('/', 1)[0]}/_new-{uuid.uuid4().hex}"
        rows, seen = batch.persist(), Observation()
        try:
            _write_split(rows, staged, folder("bad"), seen)
            _write_counts(spark, seen, folder("counts"), batch_id)
            _commit(spark, staged, folder("landed"))
        finally:
            rows.unpersist()

    return on_batch


def _count_once(capacity: DataFrame, root: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, stream_id(batch.sparkSession, checkpoint)
        folder = f"{root}/new/stream={stream}/batch={batch_id}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            others = [f"{root}/new/{name}" for name in folders(spark, f"{root}/new") if name != f"stream={stream}"]
            if others:
                known = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(*others).select(*ONCE)
                batch = batch.join(known, ONCE, "left_anti")
            batch.write.mode("overwrite").parquet(folder)
        new = spark.read.schema(batch.schema).parquet(folder)
        update(spark, f"{root}/current", CURRENT, lambda old: into_current(capacity)(old, new), (stream, batch_id))
        update(spark, f"{root}/recent", RECENT, lambda old: into_recent()(old, new), (stream, batch_id))
        for name in ("current", "recent"):
            expire(spark, f"{root}/{name}")

    return on_batch


def land(records: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Raw records to Parquet folders by lot and day."""
    dated = records.withColumn("date", F.to_date(F.substring("timestamp", 1, 10).try_cast("date")))
    return (dated.writeStream.format("parquet").partitionBy("lot_id", "date").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def _by_date(rows: DataFrame, path: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """Rows to Parquet folders by ``date``, each batch once."""
    with state_on_disk(rows.sparkSession):
        return (rows.writeStream.format("parquet").partitionBy("date").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def close_windows(events: DataFrame, late: str) -> DataFrame:
    """Departures per lot and 15-minute window as a stream: a window comes out once, and leaves the state, when no event is
    older than ``late`` before the newest.  What comes even later isn't counted here."""
    # Counted under a condition: a filter would be moved before the watermark, and arrivals would not move it on.
    counted = events.withWatermark("event_ts", late).groupBy("lot_id", F.window("event_ts", "15 minutes").alias("w")).agg(
        F.count_if(F.col("event_type") == "DEPARTURE").alias("departures_in_15m"))
    start = F.col("w.start")
    return counted.filter("departures_in_15m > 0").select("lot_id", start.alias("window_start"), "departures_in_15m", F.to_date(start).alias("date"))


def count_windows(events: DataFrame, root: str, checkpoint: str, late: str = "1 hour", every: str | None = None) -> LiveJob:
    """Departures per lot and 15-minute window, by two streams over the same events.

    ``landed`` below ``root`` takes the departures by date, ``closed`` the windows that the watermark has passed (a file per
    date and batch).  A batch writes its own rows and windows only; the state holds open windows.  ``reconcile_windows`` adds
    the departures that came behind the watermark, ``read_windows`` gives all windows, the open ones included.
    """
    left = events.filter(F.col("event_type") == "DEPARTURE").select(
        "lot_id", "event_ts", "event_type", F.to_date("event_ts").alias("date"))
    landed = _by_date(left, f"{root}/landed", f"{checkpoint}/landed", every)
    closed = close_windows(events, late).repartition("date")
    return LiveJob(landed, _by_date(closed, f"{root}/closed", f"{checkpoint}/closed", every))


def _window_parts(spark: SparkSession, root: str, days: list[str] | None = None) -> list[DataFrame]:
    """Landed departures, closed windows and corrections of the given dates, or of all."""
    dated = lambda schema: T.StructType([*schema.fields, T.StructField("date", T.DateType())])
    landed = T.StructType([T.StructField("lot_id", T.StringType()), T.StructField("event_ts", T.TimestampType()),
                           T.StructField("event_type", T.StringType())])
    parts = [read_or_empty(spark, f"{root}/{name}", dated(schema))
             for name, schema in (("landed", landed), ("closed", WINDOWS), ("corrections", WINDOWS))]
    return parts if days is None else [p.filter(F.col("date").isin(as_dates(days))) for p in parts]


def _last_closed(closed: DataFrame):
    """The newest window that was closed; with it all before it were, of every lot."""
    return closed.agg(F.max("window_start").alias("last")).scalar()


def reconcile_windows(spark: SparkSession, root: str, days: list[str] | None = None) -> None:
    """Store what closed windows of the given dates (or all) lack, since their departures came behind the watermark.

    A date's corrections replace its earlier ones, so it may run again at any time; open windows are left to the stream.
    """
    landed, closed, _ = _window_parts(spark, root, days)
    last = _last_closed(_window_parts(spark, root)[1])
    true = departures_per_window(landed).filter(F.col("window_start") <= last)
    stored = closed.withColumn("departures_in_15m", -F.col("departures_in_15m"))
    lacking = add_counts(true, stored, ["lot_id", "window_start"], "departures_in_15m").filter("departures_in_15m <> 0")
    (lacking.withColumn("date", F.to_date("window_start")).repartition("date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{root}/corrections"))


def read_windows(spark: SparkSession, root: str) -> DataFrame:
    """Departures of all windows: closed ones as stored and corrected, open ones counted from what has landed since."""
    landed, closed, corrections = _window_parts(spark, root)
    last = _last_closed(closed)
    recent = landed.filter(F.coalesce(F.col("date") >= F.to_date(last), F.lit(True)))
    still_open = departures_per_window(recent).filter(F.coalesce(F.col("window_start") > last, F.lit(True)))
    parts = closed.unionByName(corrections).select(*WINDOWS.fieldNames())
    return add_counts(still_open, parts, ["lot_id", "window_start"], "departures_in_15m").select(*WINDOWS.fieldNames())


def _numbers() -> list[Column]:
    """What is counted of a batch while it is written."""
    lots = [lot for campus in CAMPUS_LOTS.values() for lot in campus]
    unknown = ~F.coalesce(F.col("lot_id").isin(lots), F.lit(False))
    return [F.count_if(F.col("reason").isNull()).alias("processed"), F.count_if(F.col("reason").isNotNull()).alias("failed"),
            F.count_if(unknown).alias("unknown_lot")]


def _write_counts(spark: SparkSession, seen: Observation, folder: str, batch_id: int) -> None:
    found = seen.get
    row = (batch_id, *(found.get(name) or 0 for name in ("processed", "failed", "unknown_lot")))
    spark.createDataFrame([row], COUNTS).coalesce(1).write.mode("overwrite").parquet(folder)


def count_batches(records: DataFrame, as_of: str, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Per batch: accepted records, failed records and records of unknown or missing lots, and the landed batch.

    The numbers are observed in the plan that writes the batch, so a batch is read once.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        folder = lambda kind: _batch_folder(batch.sparkSession, f"{root}/{kind}", checkpoint, batch_id)
        seen = Observation()
        batch.observe(seen, *_numbers()).write.mode("overwrite").parquet(folder("landed"))
        _write_counts(batch.sparkSession, seen, folder("counts"), batch_id)

    return _start(checked(records, as_of), on_batch, checkpoint, every)


def accepted_events(records: DataFrame, as_of: str) -> DataFrame:
    return accepted(checked(records, as_of))
