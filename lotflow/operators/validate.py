"""Checks on raw events: the first broken rule names the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.domain import CAMPUS_LOTS, EVENT_TYPES, REQUIRED
from lotflow.functions.text import standard_name
from lotflow.functions.timeparts import iso_ts, strict_ts


def missing_field(fields: tuple[str, ...] = REQUIRED) -> Column:
    """``missing:<name>`` of the first null or empty field, else null."""
    return F.coalesce(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"missing:{f}")) for f in fields])


def standardise_names(events: DataFrame, *names: str) -> DataFrame:
    names = names or ("event_type", "lot_id", "campus")
    return events.withColumns({n: standard_name(F.col(n)) for n in names})


def known_event_type() -> Column:
    return F.col("event_type").isin(*EVENT_TYPES)


def known_campus(campus_lots: dict = CAMPUS_LOTS) -> Column:
    return F.col("campus").isin(*campus_lots)


def lot_on_campus(campus_lots: dict = CAMPUS_LOTS) -> Column:
    """The lot belongs to the event's own campus."""
    rules = [(F.col("campus") == c) & F.col("lot_id").isin(*lots) for c, lots in campus_lots.items()]
    return reduce(lambda a, b: a | b, rules)


def acceptable_time(ts: Column, as_of: str) -> Column:
    """A readable instant at most one minute after ``as_of``."""
    return F.coalesce(ts <= F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 1 MINUTE"), F.lit(False))


def validate(raw: DataFrame, as_of: str, campus_lots: dict = CAMPUS_LOTS) -> DataFrame:
    """All events with names standardised, ``event_ts`` parsed and ``reason`` (null = good).

    Rules run on the row alone, in this order: unreadable record, missing field, event type, campus, lot of
    the campus, time.  Missing means null or empty before trimming.
    """
    reason = missing_field()
    if "_corrupt" in raw.columns:
        reason = F.coalesce(F.when(F.col("_corrupt").isNotNull(), F.lit("bad_json")), reason)
    checked = raw.withColumn("reason", reason)
    named = standardise_names(checked).withColumn("event_ts", iso_ts(F.col("timestamp")))
    rest = (
        F.when(~known_event_type(), "event_type")
        .when(~known_campus(campus_lots), "campus")
        .when(~lot_on_campus(campus_lots), "lot")
        .when(~acceptable_time(F.col("event_ts"), as_of), "timestamp")
    )
    return named.withColumn("reason", F.coalesce(F.col("reason"), rest))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason", "_corrupt")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def parse_strict(raw: DataFrame) -> DataFrame:
    """The nightly job's parser: one exact layout, anything else null."""
    return raw.withColumn("event_ts", strict_ts(F.col("timestamp")))


def readable_ts(text: Column) -> Column:
    """The exact layout, or any other ISO-8601 time with a zone."""
    return F.coalesce(strict_ts(text), iso_ts(text))


def parse_lenient(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_ts", readable_ts(F.col("timestamp")))


def only_types(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*(types or EVENT_TYPES)))


def drop_untimed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_ts").isNotNull())


def known_lots(events: DataFrame, capacity: DataFrame) -> DataFrame:
    """Events of lots with a capacity; ``capacity`` is the lot dimension, one row per lot."""
    lots = capacity.filter(F.col("capacity") > 0).select("lot_id", "capacity")
    return events.join(lots, "lot_id")


def with_capacity(events: DataFrame, capacity: DataFrame) -> DataFrame:
    """All events, the capacity null where the lot is unknown."""
    return events.join(capacity.select("lot_id", "capacity"), "lot_id", "left")
