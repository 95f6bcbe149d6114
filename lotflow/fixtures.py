"""Parking events derived from the driver's ``events`` table, row by row.

Every source row becomes an arrival; rows of type click, view and purchase also give the departure of the same
session.  Sign-ups stay open, errors become events of an invalid type.  Nothing is joined or sorted, so the
derivation scales with the table and has no hot key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.functions.numbers import predicted_share
from lotflow.functions.timeparts import shift
from lotflow.operators.calendar import with_day_flags
from lotflow.operators.hourly import hourly_metrics, peak_spikes
from lotflow.operators.occupancy import current_occupancy, window_state
from lotflow.operators.serving import recent_events
from lotflow.operators.sessions import impute_departures
from lotflow.operators.validate import accepted, validate
from lotflow.plans.features import training_features, unified_log
from lotflow.schemas import FLAGS
from lotflow.session import shared_dir
from lotflow.sources.events import capacity_table

AS_OF = "2024-01-30 00:00:00"
SWITCH = "2024-01-23 12:00:00"
LOTS = ["NORTH", "EAST", "CENTRAL", "WEST", "SOUTH", "SRYC", "SRYE"]
WHO = ["session_id", "lot_id", "campus", "student_id", "plate_number"]
#: Lots of a size that the fixture fills.
SMALL_LOTS = {
    "BURNABY": {"NORTH": 20, "EAST": 15, "CENTRAL": 6, "WEST": 5, "SOUTH": 4}, "SURREY": {"SRYC": 5, "SRYE": 5},
}
HOLIDAYS = ["2024-01-01", "2024-01-15"]
SPECIAL = ["2024-01-09"]
SEMESTERS = [("Spring 2024", "2024-01-02", "2024-01-20", "2024-01-27")]
CALENDAR = {"semesters": SEMESTERS, "holidays": HOLIDAYS}


#: Folders written so far, per session, table set and kind.
_written: dict[tuple[str, str, str], str] = {}


class Given:
    """The driver's tables and the frames derived from them; every property is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def once(self, kind: str, write) -> str:
        """A shared folder filled by ``write(path)`` the first time it is asked for."""
        key = (self.spark.sparkContext.applicationId, self.dir, kind)
        if key not in _written:
            path = shared_dir(self.spark, kind)
            write(path)
            _written[key] = path
        return _written[key]

    def stored(self, name: str) -> DataFrame:
        """The named frame as a stored table: what the serving and exploration queries read."""
        frame = getattr(self, name)
        path = self.once(f"table-{name}", frame.write.parquet)
        return self.spark.read.schema(frame.schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _rows(source: DataFrame, fields, *kept: Column) -> DataFrame:
        """One row per event; ``fields(event_id, event_ts, event_type)`` gives the columns that differ by event."""
        ts = F.col("ts").cast("timestamp")
        stay = F.floor(F.col("value") * F.lit(240.0))
        left = F.timestamp_micros(F.unix_micros(ts) + stay * F.lit(1_000_000))
        kind = F.when(F.col("event_type") == "error", "ERROR").otherwise("ARRIVAL")
        first = F.struct(*fields(F.col("event_id") * 2, ts, kind))
        second = F.struct(*fields(F.col("event_id") * 2 + 1, left, F.lit("DEPARTURE")))
        both = F.when(F.col("event_type").isin("click", "view", "purchase"), F.array(first, second)).otherwise(F.array(first))
        return source.select(*kept, F.explode(both).alias("e")).select("e.*", *WHO[: len(kept)])

    @staticmethod
    def _who() -> list[Column]:
        place = (F.col("user_id") % 7).cast("int")
        return [
            F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("session_id"),
            F.element_at(F.array(*[F.lit(x) for x in LOTS]), place + 1).alias("lot_id"),
            F.when(place < 5, "BURNABY").otherwise("SURREY").alias("campus"),
            F.col("user_id").cast("string").alias("student_id"),
            F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("plate_number"),
        ]

    @property
    def pe(self) -> DataFrame:
        """Clean events with their own date."""
        source = self.table("events").filter(F.col("event_type") != "error")
        event = lambda event_id, event_ts, event_type: [
            event_id.alias("event_id"), event_ts.alias("event_ts"), event_type.alias("event_type")]
        return self._rows(source, event, *self._who()).withColumn("date", F.to_date("event_ts"))

    @property
    def ev(self) -> DataFrame:
        """All events, those of an invalid type included."""
        event = lambda event_id, event_ts, event_type: [
            event_id.alias("event_id"), event_ts.alias("event_ts"), event_type.alias("event_type")]
        return self._rows(self.table("events"), event, *self._who()).withColumn("date", F.to_date("event_ts"))

    @property
    def pe_min(self) -> DataFrame:
        """Times cut to minutes, so that events share an instant."""
        return self.pe.withColumn("event_ts", F.date_trunc("minute", "event_ts"))

    @property
    def pe_dup(self) -> DataFrame:
        """Every event twice, the second one a minute later under a new id."""
        again = self.pe.withColumns({"event_id": -F.col("event_id") - 1, "event_ts": shift(F.col("event_ts"), minutes=1)})
        return self.pe.unionByName(again)

    @property
    def raw(self) -> DataFrame:
        """Events as sent: text, untidy names, and some fields broken on the way.  No event is left out."""

        def as_sent(event_id: Column, event_ts: Column, event_type: Column) -> list[Column]:
            session, lot, campus, student, plate = self._who()
            text = F.date_format(event_ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            broken = lambda n: event_id % n == 0
            names = F.when(broken(89), "surrey").when(broken(101), "victoria").otherwise(F.concat(F.lower(campus), F.lit(" ")))
            return [
                event_id.alias("event_id"), session.alias("session_id"),
                F.when(broken(83), "not-a-time").otherwise(text).alias("timestamp"),
                F.concat(F.lit(" "), F.lower(event_type)).alias("event_type"), F.lower(lot).alias("lot_id"),
                names.alias("campus"), student.alias("student_id"),
                F.when(broken(97), "").otherwise(plate).alias("plate_number"), F.to_date(event_ts).alias("date"),
            ]

        return self._rows(self.table("events"), as_sent)

    @property
    def checked(self) -> DataFrame:
        return validate(self.raw, AS_OF)

    @property
    def valid(self) -> DataFrame:
        """Accepted raw events: some departures have lost their arrival."""
        return accepted(self.checked)

    @property
    def clean(self) -> DataFrame:
        return impute_departures(self.valid)

    @cached_property
    def capacity(self) -> DataFrame:
        return capacity_table(self.spark, SMALL_LOTS)

    @property
    def historical(self) -> DataFrame:
        """Events before the switch, as exported: title-case names, whole-number ids, flags, no plate."""
        flagged = with_day_flags(self.pe.filter(F.col("event_ts") < F.lit(SWITCH).cast("timestamp")),
                                 **CALENDAR, special_days=SPECIAL)
        names = ("is_holiday", "is_weekend", "is_exam_week", "is_first_2_weeks", "is_special_day")
        return flagged.select(
            "event_id", "session_id", F.col("event_ts").alias("timestamp"), F.initcap("lot_id").alias("lot_id"),
            F.initcap("event_type").alias("event_type"), F.col("student_id").cast("int").alias("student_id"),
            F.initcap("campus").alias("campus"), *[F.col(n).alias(f) for n, f in zip(names, FLAGS)], "date",
        )

    @property
    def live(self) -> DataFrame:
        """Events from the switch on, as text."""
        text = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        rows = self.pe.filter(F.col("event_ts") >= F.lit(SWITCH).cast("timestamp"))
        return rows.select("event_id", "session_id", text.alias("timestamp"), "event_type", "lot_id", "campus",
                           "student_id", "plate_number")

    @property
    def unified(self) -> DataFrame:
        return unified_log(self.historical, self.live)

    @property
    def cells(self) -> DataFrame:
        """The state of every non-empty window: all that the grid needs of the log."""
        return window_state(self.unified)

    @property
    def features(self) -> DataFrame:
        return training_features(self.unified, HOLIDAYS)

    @property
    def hours(self) -> DataFrame:
        return hourly_metrics(self.stored("clean"), self.capacity)

    @property
    def history(self) -> DataFrame:
        return peak_spikes(self.hours)

    @property
    def current(self) -> DataFrame:
        return current_occupancy(self.pe, self.capacity)

    @property
    def recent(self) -> DataFrame:
        return recent_events(self.pe)

    @property
    def forecasts(self) -> DataFrame:
        """A "no change" forecast from every feature row."""
        rows = self.stored("features").join(self.capacity.select("lot_id", "capacity"), "lot_id")
        count = F.greatest(F.lit(0), F.least(F.col("occupancy_now"), F.col("capacity")))
        return rows.select(
            "lot_id", shift(F.col("timestamp"), minutes=15).alias("forecast_time"), F.col("timestamp").alias("run_time"),
            count.alias("predicted_occupancy_count"), F.col("departures_in_15m").alias("predicted_num_departures"),
            predicted_share(count, F.col("capacity")).alias("predicted_occupancy_pct"),
        )

    @property
    def template(self) -> DataFrame:
        """A weekly class per customer."""
        key = F.col("c_custkey")
        start = (F.lit(8) + key % 9) * 60 + 30
        letters = F.array(*[F.lit(x) for x in ("M", "T", "W", "Th", "F")])
        return self.table("customer").select(
            key.cast("string").alias("student_id"),
            F.when(key % 10 == 0, "SURREY").otherwise("BURNABY").alias("campus"),
            (key % 5 + 1).alias("weekday"), F.element_at(letters, (key % 5 + 1).cast("int")).alias("day"),
            start.alias("start_time"), (start + (key % 2 + 1) * 60).alias("end_time"),
        )
