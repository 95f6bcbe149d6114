"""Occupancy from event deltas: daily running counts and counts held within a lot's capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotflow.functions.numbers import event_delta, free_spots, occupancy_rate
from lotflow.operators.ordered import PIECE, join_nulls, running_sum, with_pieces
from lotflow.operators.validate import known_lots, only_types

#: Rows gathered into one array when a piece is folded.
FOLD_ROWS = 100_000
#: Runs unfolded in one array.
BLOCK_ROWS = 512


def with_delta(events: DataFrame) -> DataFrame:
    """Valid event types only, each as +1 or -1."""
    return only_types(events).withColumn("delta", event_delta(F.col("event_type")))


def daily_running_occupancy(events: DataFrame, **limits: int) -> DataFrame:
    """Count per lot and date; events of one instant share the value.  Unclamped, restarts each date."""
    return running_sum(with_delta(events), "delta", "current_occupancy", keys=["lot_id", "date"],
                       ties_share=True, **limits)


def running_occupancy_rows(events: DataFrame, **limits: int) -> DataFrame:
    """Count per lot and own date, event by event in (event_ts, event_id) order."""
    dated = with_delta(events).withColumn("date", F.to_date("event_ts"))
    return running_sum(dated, "delta", "occupancy_now", keys=["lot_id", "date"], **limits)


# --- occupancy held within [0, capacity] ---------------------------------------------------------------
#
# One event maps x to min(cap, max(0, x + d)).  A run of such steps is always of the form
# x -> max(lo, min(hi, x + s)), so a run is kept as the triple (s, lo, hi), and runs combine in any grouping.


def _then(a: Column, b: Column) -> Column:
    """The triple of run ``a`` followed by run ``b``."""
    lo, hi = b["lo"], b["hi"]
    return F.struct(
        (a["s"] + b["s"]).alias("s"),
        F.greatest(lo, F.least(hi, a["lo"] + b["s"])).alias("lo"),
        F.greatest(lo, F.least(hi, a["hi"] + b["s"])).alias("hi"),
    )


def _fold(order: list[str]) -> list[Column]:
    """Aggregates joining a group's triples in order, and the group's last event."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "s", "lo", "hi")))
    triples = F.transform(parts, lambda p: F.struct(p["s"], p["lo"], p["hi"]))
    return [
        F.aggregate(F.slice(triples, 2, F.greatest(F.size(triples) - 1, F.lit(0))), triples[0], _then).alias("run"),
        F.max("last").alias("last"),
    ]


def _steps(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    limits = {"hot_rows": FOLD_ROWS, **limits}
    steps = known_lots(with_delta(events), capacity).select(
        "lot_id", "event_ts", "event_id", F.col("delta").alias("s"), F.lit(0).cast("bigint").alias("lo"),
        F.col("capacity").alias("hi"),
    )
    return with_pieces(steps, ["lot_id"], **limits)


def _piece_runs(steps: DataFrame) -> DataFrame:
    """One triple per piece; a piece has at most FOLD_ROWS events."""
    with_last = steps.withColumn("last", F.struct("event_ts", "event_id"))
    folded = with_last.groupBy("lot_id", *PIECE).agg(*_fold(["event_ts", "event_id", "_spread"]))
    return folded.select("lot_id", *PIECE, "run.*", "last")


def _coarser(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*_fold(order)).select(*keys, "run.*", "last")


def _day_runs(pieces: DataFrame) -> DataFrame:
    """Pieces to slices, slices to days.

    A slice that was cut has at most 10^6 instants and one more piece per FOLD_ROWS events; a day has at most 86,400
    slices.  So every step gathers few triples however many events there are.
    """
    slices = _coarser(pieces, ["lot_id", "_slice"], ["_instant", "_block"])
    return _coarser(slices.withColumn("_day", F.to_date("_slice")), ["lot_id", "_day"], ["_slice"])


def lot_runs(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    """One triple per lot for all its events, with the last event's time: what a micro-batch adds to the state."""
    days = _day_runs(_piece_runs(_steps(events, capacity, **limits)))
    lots = _coarser(days, ["lot_id"], ["_day"])
    return lots.select("lot_id", "s", "lo", "hi", F.col("last.event_ts").alias("last_updated_ts"))


def apply_run(start: Column) -> Column:
    return F.greatest(F.col("lo"), F.least(F.col("hi"), start + F.col("s")))


def snapshot(lots: DataFrame, capacity: DataFrame, occupied: Column) -> DataFrame:
    """Snapshot rows from per-lot state; ``capacity`` is the lot dimension."""
    dim = capacity.select("lot_id", F.col("campus").alias("campus_name"), "capacity")
    held = lots.withColumn("current_occupancy", occupied)
    return held.join(dim, "lot_id").select(
        "lot_id", "campus_name", "capacity", "current_occupancy",
        free_spots(F.col("current_occupancy"), F.col("capacity")).alias("free_spots"),
        occupancy_rate(F.col("current_occupancy"), F.col("capacity")).alias("occupancy_rate"), "last_updated_ts",
    )


def current_occupancy(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    """Snapshot of every lot after all events, starting empty."""
    return snapshot(lot_runs(events, capacity, **limits), capacity, apply_run(F.lit(0).cast("bigint")))


def _held(run: Column, start: Column) -> Column:
    """What a run makes of a count."""
    return F.greatest(run["lo"], F.least(run["hi"], start + run["s"]))


def _path(runs: Column, start: Column) -> Column:
    """The count before the first of the runs, then the one after each."""
    return F.aggregate(runs, F.array(start), lambda path, run: F.concat(path, F.array(_held(run, F.element_at(path, -1)))))


def _triples(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["s"], e["lo"], e["hi"]))


def _values(rows: DataFrame, starts: DataFrame, group: list[str], order: list[str], kept: list[str], out: str, *, after: bool) -> DataFrame:
    """``kept`` columns of every run and, as ``out``, the count before it, or ``after`` it.

    ``rows(group, order, s, lo, hi)`` are runs, ``starts(group, _start)`` the count at which each group begins.  A group is
    cut into blocks of BLOCK_ROWS runs; a block is folded to one run, the blocks' runs give each block its start, and a
    block's own runs unfold from there.  No array is longer than a block, or than the blocks of a group.
    """
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    cut = rows.withColumn("_part", F.floor((place - 1) / BLOCK_ROWS))
    entry = F.struct(*order, "s", "lo", "hi", *[c for c in kept if c not in [*order, *group]])
    blocks = cut.groupBy(*group, "_part").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    triples = _triples(F.col("_entries"))
    run = F.aggregate(F.slice(triples, 2, F.greatest(F.size(triples) - 1, F.lit(0))), triples[0], _then)
    folded = blocks.select(*group, F.struct("_part", run.alias("run")).alias("block"))
    ends = folded.groupBy(*group).agg(F.sort_array(F.collect_list("block")).alias("_blocks"))
    ends = join_nulls(ends, starts, group)
    path = _path(F.transform("_blocks", lambda b: b["run"]), F.col("_start"))
    begun = ends.select(*group, F.posexplode(F.slice(path, F.lit(1), F.size("_blocks"))).alias("_part", "_start"))
    placed = join_nulls(blocks, begun.withColumn("_part", F.col("_part").cast("bigint")), [*group, "_part"])
    first = F.lit(2) if after else F.lit(1)
    counts = F.slice(_path(triples, F.col("_start")), first, F.size("_entries"))
    unfolded = placed.select(*group, F.inline(F.arrays_zip(F.col("_entries").alias("e"), counts.alias("x"))))
    return unfolded.select(*group, *[F.col(f"e.{c}").alias(c) for c in kept if c not in group], F.col("x").alias(out))


def clamped_occupancy(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    """The held count after every event, per lot, in (event_ts, event_id) order, starting empty.

    Start values go down the levels: days of a lot (one row per day), pieces of a lot-day, events of a piece.  Every
    level is a scan in blocks of BLOCK_ROWS runs (``_values``), so no group is held in one array.
    """
    steps = _steps(events, capacity, **limits)
    pieces = _piece_runs(steps).drop("last").withColumn("_day", F.to_date("_slice"))
    zero = capacity.select("lot_id", F.lit(0).cast("bigint").alias("_start"))
    by_day = _day_runs(_piece_runs(steps)).drop("last")
    days = _values(by_day, zero, ["lot_id"], ["_day"], ["lot_id", "_day"], "_start", after=False)
    starts = _values(pieces, days, ["lot_id", "_day"], PIECE, ["lot_id", *PIECE], "_start", after=False).drop("_day")
    return _values(steps, starts, ["lot_id", *PIECE], ["event_ts", "event_id", "_spread"],
                   ["lot_id", "event_ts", "event_id"], "occupancy", after=True).drop(*PIECE)


def day_runs(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    """One triple per lot and own date."""
    days = _day_runs(_piece_runs(_steps(events, capacity, **limits)))
    return days.select("lot_id", F.col("_day").alias("date"), "s", "lo", "hi")


def daily_counts(events: DataFrame, capacity: DataFrame, **limits: int) -> DataFrame:
    """The held count at the end of each lot's day when counters restart every day."""
    runs = day_runs(events, capacity, **limits)
    return runs.select("lot_id", "date", apply_run(F.lit(0).cast("bigint")).alias("occupancy"))


# --- state per 15-minute window ------------------------------------------------------------------------


def window_state(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Last running count and exam flag, and the departures, of every non-empty window.

    The running count restarts at midnight and a window lies within one day, so the last count of a window is the
    day's sum of window totals up to it.  Events are therefore only summed, before the shuffle; nothing is sorted.
    A lot lies on one campus (rule of validation); the state is that of the lot.
    """
    flags = "is_exam_week" in events.columns
    last_flag = F.max(F.when(F.col("is_exam_week").isNotNull(), F.struct("event_ts", "event_id", "is_exam_week")))
    totals = (
        with_delta(events)
        .groupBy("lot_id", "campus", F.window("event_ts", width).alias("w"))
        .agg(
            F.sum("delta").alias("_net"),
            F.count_if(F.col("event_type") == "DEPARTURE").alias("departures"),
            *([last_flag.getField("is_exam_week").alias("is_exam_week")] if flags else []),
        )
        .withColumn("window_start", F.col("w.start"))
    )
    so_far = (
        W.partitionBy("lot_id", F.to_date("window_start")).orderBy("window_start")
        .rangeBetween(W.unboundedPreceding, 0)
    )
    return totals.withColumn("occupancy_now", F.sum("_net").over(so_far)).drop("_net", "w")


def departures_per_window(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    left = events.filter(F.col("event_type") == "DEPARTURE")
    counted = left.groupBy("lot_id", F.window("event_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("departures_in_15m"))
    return counted.select("lot_id", F.col("w.start").alias("window_start"), "departures_in_15m")
