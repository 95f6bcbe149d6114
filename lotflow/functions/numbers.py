"""Clamps, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotflow.domain import JUDGEMENTS, PEAK_SHARE


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def event_delta(event_type: Column) -> Column:
    """+1 for an arrival, -1 for a departure, null for anything else."""
    return F.when(event_type == "ARRIVAL", F.lit(1)).when(event_type == "DEPARTURE", F.lit(-1)).cast("bigint")


def occupancy_rate(occupied: Column, capacity: Column) -> Column:
    return F.try_divide(occupied.cast("double"), capacity.cast("double"))


def free_spots(occupied: Column, capacity: Column) -> Column:
    return capacity - occupied


def rate_pct(rate: Column) -> Column:
    """Percentage with two places, ties to even."""
    return F.bround(rate * F.lit(100.0), 2)


def peak_ratio(peak: Column, capacity: Column) -> Column:
    return F.try_divide(peak.cast("double"), capacity.cast("double"))


def is_peak(peak: Column, capacity: Column, share: float = PEAK_SHARE) -> Column:
    """1 when the share is reached, else 0; an unknown capacity gives 0."""
    return F.when(peak_ratio(peak, capacity) >= F.lit(share), 1).otherwise(0)


def predicted_count(raw: Column, capacity: Column | None = None) -> Column:
    """Prediction as a whole number, ties to even, at least 0 and at most the capacity."""
    whole = F.bround(raw, 0).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), whole if capacity is None else F.least(whole, capacity.cast("bigint")))


def predicted_share(count: Column, capacity: Column) -> Column:
    """Share of the capacity with two places; 0 when there are no spots."""
    return F.when(capacity > 0, F.bround(count.cast("double") / capacity.cast("double"), 2)).otherwise(F.lit(0.0))


def fill_pct(occupied: Column, capacity: Column) -> Column:
    """Share in percent, held within 0..100; 0 when there are no spots."""
    share = F.try_divide(occupied * F.lit(100.0), capacity.cast("double"))
    return F.when(capacity > 0, clamp(share, F.lit(0.0), F.lit(100.0))).otherwise(F.lit(0.0))


def available(occupied: Column, capacity: Column) -> Column:
    return F.greatest(capacity - occupied, F.lit(0).cast("bigint"))


def judgement(pct: Column) -> Column:
    """Status label of a fill percentage."""
    label = F.when(pct > 0, "VERY LIGHT").otherwise("EMPTY")
    for start, text in reversed(JUDGEMENTS):
        label = F.when(pct >= start, text).otherwise(label)
    return label


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards, also for negatives."""
    return F.floor(value + F.lit(0.5))
