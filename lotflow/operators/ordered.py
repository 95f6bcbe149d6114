"""Running values over few, very large, time-ordered keys.

A window over (lot, date) would sort a whole lot-day in one task.  Here each key is cut into pieces by size:

* an hour of a key with at most ``hot_rows`` events is one piece;
* a larger hour is cut into seconds, so a day has at most 86,400 of them;
* a larger second is cut by instant (at most 10^6 microseconds) and by event id, at ids that share its rows out evenly: as
  many cuts as the second has times ``hot_rows`` events, so not even one instant holding a third of all rows lands in
  one task.  An id that many rows share is itself cut by a hash of the row.

Pieces are worked on in parallel; the totals of earlier pieces are added afterwards.  All joins take nulls for equal:
rows with a null key, time or id are kept, in the order nulls first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
#: Into how many shares the ids of a hot second are measured.
QUANTILES = 128

PIECE = ["_slice", "_instant", "_block"]


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the keys stay those of the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def seconds_of(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Events per key and second."""
    return events.groupBy(*keys, F.date_trunc("second", F.col(ts)).alias("_second")).agg(F.count(F.lit(1)).alias("_n"))


def large_hours(seconds: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Hours with more than ``hot_rows`` events."""
    hours = seconds.groupBy(*keys, F.date_trunc("hour", "_second").alias("_hour")).agg(F.sum("_n").alias("_n"))
    return hours.filter(F.col("_n") > hot_rows).select(*keys, "_hour", F.lit(True).alias("_large"))


def hot_seconds(events: DataFrame, seconds: DataFrame, keys: list[str], ts: str, tie: str, hot_rows: int) -> DataFrame:
    """Seconds that alone have more than ``hot_rows`` events: the parts each is to be cut into and ``QUANTILES`` of its ids.

    There is at most one such second per ``hot_rows`` events, so their keys are broadcast; where there is none, the
    events are not read for it.
    """
    parts = F.ceil(F.col("_n") / F.lit(float(max(hot_rows, 1)))).cast("bigint")
    hot = seconds.filter(F.col("_n") > hot_rows).select(*keys, "_second", parts.alias("_parts"))
    inside = join_nulls(events.select(*keys, tie, F.date_trunc("second", F.col(ts)).alias("_second")),
                        F.broadcast(hot), [*keys, "_second"])
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    return inside.groupBy(*keys, "_second").agg(
        F.first("_parts").alias("_parts"), F.percentile_approx(tie, shares, 10_000).alias("_ids"))


def _share_before(tie: Column, ids: Column, spread: Column) -> Column:
    """About the share of a second's rows that come before a row, never falling in (``tie``, ``spread``) order.

    ``ids`` are quantiles: between two of them the share rises evenly with the id, and over those that are one and the same
    id (so many rows share it) with ``spread``.
    """
    count = F.size(ids)
    placed = F.array_sort(F.array_append(ids, tie))
    below = F.array_position(placed, tie) - 1
    same = count + 1 - F.array_position(F.reverse(placed), tie) - below
    low, high = (F.try_element_at(ids, i.cast("int")).cast("double") for i in (below, below + 1))
    between = below - 1 + F.least((tie.cast("double") - low) / (high - low), F.lit(1.0))
    rank = F.when(same > 0, below + spread * (same - 1)).when(below == 0, 0.0).when(below == count, count - 1.0).otherwise(between)
    return rank / QUANTILES


def with_pieces(events: DataFrame, keys: list[str], *, ts: str = "event_ts", tie: str = "event_id",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the piece columns; ordering by (``ts``, ``tie``, ``_spread``) is the order of pieces, then that inside them.

    ``tie`` is a number; equal and null ones are ordered by a hash of the row.  A hot second is cut at quantiles of its
    ids, so far ids and ids shared by many rows don't make its pieces uneven; rows without id come first, cut at equal steps
    of their hash.  A piece has up to twice ``hot_rows`` events, or 2 in ``QUANTILES`` of its second if that is more; only rows
    that are the same in every column are never parted.  ``_split`` tells rows of a second that was cut by instant.
    """
    time = F.col(ts)
    seconds = seconds_of(events, keys, ts)
    timed = events.withColumns({
        "_hour": F.date_trunc("hour", time), "_second": F.date_trunc("second", time),
        "_spread": F.xxhash64(*[F.col(c) for c in events.columns])})
    marked = join_nulls(timed, large_hours(seconds, keys, hot_rows), [*keys, "_hour"], "left")
    cut = join_nulls(marked, hot_seconds(events, seconds, keys, ts, tie, hot_rows), [*keys, "_second"], "left")
    parts, spread = F.col("_parts"), F.col("_spread").cast("double") / 2.0**64 + 0.5
    part = lambda share: F.least(F.floor(share * parts), parts - 1)
    block = F.when(F.col(tie).isNull(), part(spread) - parts).otherwise(part(_share_before(F.col(tie), F.col("_ids"), spread)))
    return cut.withColumns({
        "_slice": F.when(F.col("_large"), F.col("_second")).otherwise(F.col("_hour")),
        "_split": parts.isNotNull(),
    }).withColumns({
        "_instant": F.when(F.col("_split"), time).otherwise(F.col("_slice")),
        "_block": F.when(F.col("_split"), block).otherwise(F.lit(0).cast("bigint")),
    }).drop("_hour", "_second", "_large", "_parts", "_ids")


def running_sum(events: DataFrame, delta: str, out: str, *, keys: list[str], ts: str = "event_ts",
                tie: str = "event_id", ties_share: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running sum of ``delta`` per key in (``ts``, ``tie``) order.

    ``ties_share=False`` counts row by row (ROWS frame); ``ties_share=True`` gives all rows of an instant the sum
    through that instant (RANGE frame).  Events move in one shuffle, on the piece; the totals join on the same key.
    """
    pieces = with_pieces(events, keys, ts=ts, tie=tie, hot_rows=hot_rows)
    totals = pieces.groupBy(*keys, *PIECE).agg(F.sum(delta).alias("_net"))
    earlier = W.partitionBy(*keys).orderBy(*PIECE).rowsBetween(W.unboundedPreceding, -1)
    through = W.partitionBy(*keys).orderBy("_slice", "_instant").rangeBetween(W.unboundedPreceding, 0)
    starts = totals.withColumns({
        "_before": F.coalesce(F.sum("_net").over(earlier), F.lit(0)), "_through": F.sum("_net").over(through),
    }).drop("_net")
    inside = W.partitionBy(*keys, *PIECE)
    if ties_share:
        frame = inside.orderBy(ts).rangeBetween(W.unboundedPreceding, 0)
        value = F.when(F.col("_split"), F.col("_through")).otherwise(F.col("_before") + F.col("_inside"))
    else:
        frame = inside.orderBy(ts, tie, "_spread").rowsBetween(W.unboundedPreceding, 0)
        value = F.col("_before") + F.col("_inside")
    placed = pieces.repartition(*keys, *PIECE).withColumn("_inside", F.sum(delta).over(frame))
    return join_nulls(placed, starts, [*keys, *PIECE]).select(*events.columns, value.alias(out))


def global_rank(ids: DataFrame, hashed: str, out: str = "_rank") -> DataFrame:
    """1-based rank of every row by a hex hash column, without sorting everything in one task.

    Rows are ranked inside their 4-digit hash prefix; the at most 65,536 prefix counts give the offsets.
    """
    prefixed = ids.withColumn("_prefix", F.substring(hashed, 1, 4))
    counts = prefixed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_prefix").orderBy(hashed))
    ranked = prefixed.withColumn("_inside", inside).join(F.broadcast(offsets), "_prefix")
    return ranked.withColumn(out, F.col("_inside") + F.col("_offset")).drop("_prefix", "_inside", "_offset")
