"""The regular lot x 15-minute grid: skeleton, gap fill, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotflow.functions.timeparts import shift

CELL = ["lot_id", "campus", "window_start"]


def time_bounds(cells: DataFrame) -> DataFrame:
    """First and last window start, as one row that stays in the plan."""
    return cells.agg(F.min("window_start").alias("min_ts"), F.max("window_start").alias("max_ts"))


def time_skeleton(cells: DataFrame, minutes: int = 15) -> DataFrame:
    """Every lot at every grid time between the first and last window.

    The bounds are scalar subqueries and each lot row unfolds its own times, so there is no join.
    """
    bounds = time_bounds(cells)
    times = F.sequence(bounds.select("min_ts").scalar(), bounds.select("max_ts").scalar(),
                       F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return cells.select("lot_id", "campus").distinct().withColumn("window_start", F.explode(times))


def fill_grid(cells: DataFrame) -> DataFrame:
    """The skeleton with the observed state where there is one."""
    return time_skeleton(cells).join(cells, CELL, "left")


def forward_fill(grid: DataFrame, *columns: str) -> DataFrame:
    """Carry the last known value over gaps, also over midnight.

    A lot has 96 rows a day whatever the number of events, so one lot's grid is small.
    """
    up_to_now = W.partitionBy("lot_id", "campus").orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumns({c: F.last(c, ignorenulls=True).over(up_to_now) for c in columns})


def next_window_value(grid: DataFrame, column: str, out: str) -> DataFrame:
    """Value of the following window; on the complete grid this is the row 15 minutes later."""
    w = W.partitionBy("lot_id", "campus").orderBy("window_start")
    return grid.withColumn(out, F.lead(column, 1).over(w))


def join_next_window(grid: DataFrame, column: str, out: str, minutes: int = 15) -> DataFrame:
    """The same label as a self-join on the shifted window start; also right on a grid with gaps."""
    later = grid.select("lot_id", "campus", shift(F.col("window_start"), minutes=-minutes).alias("window_start"),
                        F.col(column).alias(out))
    return grid.join(later, CELL, "left")


def label_departures(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """Departures within the row's own window, 0 where there are none."""
    return grid.join(counts, ["lot_id", "window_start"], "left").fillna(0, subset=["departures_in_15m"])


def dense_grid(cells: DataFrame, minutes: int = 15) -> DataFrame:
    """The complete grid with carried state, the next window's state and the window's own departures, in one pass.

    Each observed window unfolds into itself and the gap after it; a lot's first window also into the gap before
    it, where the state is 0.  This gives the rows of skeleton, join, forward fill and ``lead`` without building
    any of them: the only shuffle is that of the observed windows.
    """
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    bounds = time_bounds(cells)
    first, last = bounds.select("min_ts").scalar(), bounds.select("max_ts").scalar()
    in_order = W.partitionBy("lot_id", "campus").orderBy("window_start")
    observed = cells.withColumns({
        "_first": F.lag("window_start").over(in_order).isNull(),
        "_next": F.lead("window_start").over(in_order),
        "_next_state": F.lead("occupancy_now").over(in_order),
        "is_exam_week": F.last("is_exam_week", ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, 0)),
    })
    start = F.col("window_start")
    own = F.sequence(start, F.coalesce(F.col("_next") - step, last), step)
    ahead = F.when(F.col("_first") & (start > first), F.sequence(first, start - step, step))
    times = F.concat(F.coalesce(ahead, F.slice(own, 1, 0)), own)
    rows = observed.withColumn("t", F.explode(times))
    before = F.col("t") < start
    later = F.col("t") + step
    zero = F.lit(0).cast("bigint")
    following = (
        F.when(later < start, zero)
        .when((later >= start) & F.coalesce(later < F.col("_next"), later <= last), F.col("occupancy_now"))
        .otherwise(F.coalesce("_next_state", zero))
    )
    return rows.select(
        "lot_id", "campus", F.col("t").alias("window_start"), F.when(before, zero).otherwise(F.col("occupancy_now")).alias("occupancy_now"),
        F.when(~before, F.col("is_exam_week")).alias("is_exam_week"), following.alias("occupancy_next"),
        F.when(F.col("t") == start, F.col("departures")).otherwise(zero).alias("departures"),
    )
