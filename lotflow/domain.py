"""Fixed values of the parking domain.

Everything here is data: operators take it as a parameter and use these values only as defaults.
"""

from __future__ import annotations

from datetime import date

# Campus -> lot -> number of spots.
CAMPUS_LOTS = {
    "BURNABY": {"NORTH": 2000, "EAST": 1500, "CENTRAL": 600, "WEST": 500, "SOUTH": 400},
    "SURREY": {"SRYC": 450, "SRYE": 450},
}

# Event types and the fields every event must carry, in the order they are checked.
EVENT_TYPES = ("ARRIVAL", "DEPARTURE")
REQUIRED = ("session_id", "timestamp", "event_type", "lot_id", "campus", "student_id", "plate_number")

# Statutory holidays and special days.
HOLIDAYS = [
    "2022-02-21", "2022-04-15", "2022-10-10", "2022-11-11", "2023-10-09", "2023-11-13", "2024-02-12",
    "2024-03-29", "2024-10-14", "2024-11-11", "2025-02-17", "2025-04-18", "2025-10-13", "2025-11-11",
]
SPECIAL_DAYS = [
    "2022-06-07", "2022-06-10", "2022-10-06", "2022-10-07", "2023-10-05", "2023-10-06", "2024-06-11",
    "2024-06-14", "2024-10-03", "2024-10-04", "2025-06-10", "2025-06-13", "2025-10-02", "2025-10-03",
]

# Fixed values: (name, first day, last class day, last exam day).
SEMESTERS = [
    ("Spring 2022", "2022-01-10", "2022-04-11", "2022-04-26"),
    ("Fall 2022", "2022-09-07", "2022-12-06", "2022-12-19"),
    ("Spring 2023", "2023-01-04", "2023-04-11", "2023-04-24"),
    ("Fall 2023", "2023-09-05", "2023-12-08", "2023-12-22"),
    ("Spring 2024", "2024-01-08", "2024-04-12", "2024-04-26"),
    ("Fall 2024", "2024-09-03", "2024-12-06", "2024-12-20"),
    ("Spring 2025", "2025-01-06", "2025-04-11", "2025-04-25"),
    ("Fall 2025", "2025-09-02", "2025-12-05", "2025-12-19"),
]

# Thresholds and zones.
PEAK_SHARE = 0.80
LOCAL_ZONE = "America/Vancouver"
STRICT_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
EXPORT_TS = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
WINDOW = "15 minutes"
GRACE_HOURS = 4
KEEP_PER_LOT = 5

# Model input columns in training order.
MODEL_FEATURES = [
    "occupancy_now", "day_of_week", "hour_of_day", "is_holiday", "is_weekend", "is_exam_week",
    "lot_id_CENTRAL", "lot_id_EAST", "lot_id_NORTH", "lot_id_SOUTH", "lot_id_SRYC", "lot_id_SRYE", "lot_id_WEST",
    "campus_BURNABY", "campus_SURREY",
]

# Share of a full lot at which each label starts, highest first.
JUDGEMENTS = [(100, "FULL"), (90, "ALMOST FULL"), (70, "BUSY"), (40, "MODERATE"), (10, "LIGHT")]


def capacity_rows(campus_lots: dict[str, dict[str, int]] = CAMPUS_LOTS) -> list[tuple[str, str, int]]:
    """(campus, lot, capacity) rows."""
    return [(campus, lot, spots) for campus, lots in campus_lots.items() for lot, spots in lots.items()]


def as_dates(days: list[str]) -> list[date]:
    return [date.fromisoformat(d) for d in days]
