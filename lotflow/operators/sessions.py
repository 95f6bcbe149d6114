"""Arrivals and departures brought together by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.domain import EVENT_TYPES, GRACE_HOURS
from lotflow.functions.timeparts import seconds_between, shift

DETAILS = ("lot_id", "campus", "student_id", "plate_number", "date")


def first_of_each(events: DataFrame) -> DataFrame:
    """One row per (session, type): the earliest; repeats come from retried sends.

    A min over a struct is combined before the shuffle, so a session repeated many times costs one row per task.
    Events without a session id are no repeats of each other: all stay.
    """
    rest = [c for c in events.columns if c not in ("session_id", "event_type")]
    order = ["event_ts", "event_id", *[c for c in rest if c not in ("event_ts", "event_id")]]
    kept = events.filter("session_id is not null").groupBy("session_id", "event_type").agg(F.min(F.struct(*order)).alias("_first"))
    first = kept.select("session_id", "event_type", "_first.*").select(*events.columns)
    return first.unionByName(events.filter("session_id is null"))


def pair_sessions(events: DataFrame) -> DataFrame:
    """One row per arrived session with its earliest departure, null if there is none.

    The left join of arrivals to departures is one grouped pass: conditional minima over the session, combined
    before the single shuffle, so a session id shared by very many rows stays cheap.  Events without a
    session id cannot be paired and stay apart.  Departures without an arrival are left out.
    """
    details = [c for c in DETAILS if c in events.columns]
    arrival = F.when(F.col("event_type") == "ARRIVAL", F.struct("event_ts", "event_id", *details))
    departure = F.when(F.col("event_type") == "DEPARTURE", F.col("event_ts"))
    alone = F.when(F.col("session_id").isNull(), F.col("event_id"))
    paired = (
        events.groupBy("session_id", alone.alias("_alone"))
        .agg(F.min(arrival).alias("a"), F.min(departure).alias("departure_ts"))
        .filter(F.col("a").isNotNull())
    )
    return paired.select(
        "session_id", F.col("a.event_ts").alias("arrival_ts"), "departure_ts",
        F.col("a.event_id").alias("arrival_id"), *[F.col(f"a.{c}") for c in details],
    )


def close_sessions(pairs: DataFrame, hours: int = GRACE_HOURS) -> DataFrame:
    """Fill a missing departure with arrival + ``hours``."""
    end = F.coalesce("departure_ts", shift(F.col("arrival_ts"), hours=hours))
    return pairs.withColumn("departure_ts", end)


def as_events(pairs: DataFrame) -> DataFrame:
    """Two event rows per pair, made in place instead of a union of two scans.

    Both rows keep the pair's ``date`` (the arrival's day), also past midnight.
    """
    details = [c for c in DETAILS if c in pairs.columns]
    rows = F.explode(F.array(
        F.struct(F.lit("ARRIVAL").alias("event_type"), F.col("arrival_ts").alias("event_ts")),
        F.struct(F.lit("DEPARTURE").alias("event_type"), F.col("departure_ts").alias("event_ts")),
    ))
    return pairs.select("session_id", *details, rows.alias("e")).select("session_id", "e.*", *details)


def impute_departures(events: DataFrame, hours: int = GRACE_HOURS) -> DataFrame:
    """Cleaned log: every arrived session has exactly one arrival and one departure."""
    return as_events(close_sessions(pair_sessions(events), hours))


def with_arrival(events: DataFrame) -> DataFrame:
    """Departures whose session arrived (semi join)."""
    return _departures(events, "left_semi")


def without_arrival(events: DataFrame) -> DataFrame:
    """Departures whose session never arrived (anti join)."""
    return _departures(events, "left_anti")


def _departures(events: DataFrame, how: str) -> DataFrame:
    arrived = events.filter(F.col("event_type") == "ARRIVAL").select("session_id").distinct()
    return events.filter(F.col("event_type") == "DEPARTURE").join(arrived, "session_id", how)


def session_pivot(events: DataFrame) -> DataFrame:
    """Latest arrival and departure per session as columns; the value list is declared, so both always exist."""
    wide = events.groupBy("session_id").pivot("event_type", list(EVENT_TYPES)).agg(F.max("event_ts"))
    return wide.withColumnsRenamed({"ARRIVAL": "arrival_ts", "DEPARTURE": "departure_ts"})


def complete_only(pairs: DataFrame) -> DataFrame:
    return pairs.dropna(subset=["arrival_ts", "departure_ts"])


def session_durations(events: DataFrame) -> DataFrame:
    """Whole seconds and minutes per complete session."""
    seconds = seconds_between(F.col("arrival_ts"), F.col("departure_ts"))
    return complete_only(session_pivot(events)).select(
        "session_id", seconds.alias("duration_seconds"), (seconds / F.lit(60.0)).alias("duration_minutes")
    )


def attach_duration(events: DataFrame) -> DataFrame:
    """Every event with its session's duration, null while the session is open.

    The duration side has one row per session; if one session id holds much of the event side, adaptive
    execution splits that partition.
    """
    return events.join(session_durations(events), "session_id", "left")
