"""Dates: flags, semesters, weekly templates and populations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.domain import HOLIDAYS, SEMESTERS, SPECIAL_DAYS, as_dates
from lotflow.functions.timeparts import in_days, is_weekend
from lotflow.operators.ordered import global_rank
from lotflow.schemas import SEMESTER
from lotflow.session import literal_rows

FLAG_NAMES = ("is_holiday", "is_weekend", "is_exam_week", "is_first_2_weeks", "is_special_day")
BUSY_DAYS = 14


def semester_dates(spark: SparkSession, semesters: list[tuple] = SEMESTERS, holidays: list[str] = HOLIDAYS) -> DataFrame:
    """(date, semester, period) for every date of every semester.

    Turning the few ranges into dates makes the range join an equality join; there is one row per calendar day.
    A weekend or holiday is an ``off_day``; other days are ``busy`` for two weeks, ``regular`` until classes end,
    then ``exam``.
    """
    terms = literal_rows(spark, semesters, SEMESTER)
    dates = terms.select("semester", "start", "class_end", F.explode(F.sequence("start", "sem_end")).alias("date"))
    day = F.col("date")
    period = (
        F.when(is_weekend(day) | in_days(day, as_dates(holidays)), "off_day")
        .when(day < F.date_add("start", BUSY_DAYS), "busy")
        .when(day <= F.col("class_end"), "regular")
        .otherwise("exam")
    )
    return dates.select("date", "semester", period.alias("period"))


def classify_period(rows: DataFrame, semesters: list[tuple] = SEMESTERS, holidays: list[str] = HOLIDAYS) -> DataFrame:
    """Add semester and period by ``date``; ``out`` outside all semesters."""
    dates = semester_dates(rows.sparkSession, semesters, holidays)
    joined = rows.join(dates, "date", "left")
    return joined.withColumn("period", F.coalesce("period", F.lit("out")))


def with_day_flags(rows: DataFrame, semesters: list[tuple] = SEMESTERS, holidays: list[str] = HOLIDAYS,
                   special_days: list[str] = SPECIAL_DAYS) -> DataFrame:
    """The five flags of the historical log, from ``date``."""
    day = F.col("date")
    known = classify_period(rows, semesters, holidays)
    return known.withColumns({
        "is_holiday": in_days(day, as_dates(holidays)), "is_weekend": is_weekend(day),
        "is_exam_week": F.col("period") == "exam", "is_first_2_weeks": F.col("period") == "busy",
        "is_special_day": in_days(day, as_dates(special_days)),
    }).drop("semester", "period")


def calendar_of(history: DataFrame) -> DataFrame:
    """One row per date with its flags; if rows of a date disagree, true wins."""
    return history.groupBy("date").agg(*[F.bool_or(f).alias(f) for f in FLAG_NAMES])


def backfill_flags(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fill null flags from the date; ``calendar`` has one row per date, so its size is the number of days."""
    known = calendar.select("date", *[F.col(f).alias(f"_{f}") for f in FLAG_NAMES])
    filled = {f: F.coalesce(F.col(f), F.col(f"_{f}")) for f in FLAG_NAMES}
    joined = events.join(known, "date", "left").withColumns(filled)
    return joined.select(*events.columns)


def off_day(day: Column, holidays: list[str] = HOLIDAYS) -> Column:
    return is_weekend(day) | in_days(day, as_dates(holidays))


def term_days(start: str | date, end: str | date, keep) -> Column:
    """Array of the dates of a term for which ``keep`` holds; at most one entry per day."""
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    return F.filter(days, keep)


def expand_weekly_template(template: DataFrame, start: str, end: str, *, by_letter: bool = False) -> DataFrame:
    """One row per template row and matching date.

    Matches on the weekday number (1 = Monday).  ``by_letter`` keeps the older rule, in which a row matches any
    weekday whose first letter occurs in its ``day`` text, so Tuesday and Thursday rows match both days.
    """
    if by_letter:
        matches = lambda d: (F.weekday(d) < 5) & F.col("day").contains(F.substring(F.date_format(d, "E"), 1, 1))
    else:
        matches = lambda d: F.weekday(d) + 1 == F.col("weekday")
    return template.withColumn("date", F.explode(term_days(start, end, matches)))


def daily_summary(schedule: DataFrame) -> DataFrame:
    """First start and last end per student, date and campus."""
    return schedule.groupBy("student_id", "date", "campus").agg(
        F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")
    )


def ranked_ids(rows: DataFrame, id_column: str) -> DataFrame:
    ids = rows.select(id_column).distinct().withColumn("_hash", F.md5(F.col(id_column)))
    return global_rank(ids, "_hash").drop("_hash")


def _share_of_ids(rows: DataFrame, id_column: str, share: float):
    """How many ids the share comes to, as a scalar in the plan."""
    return F.floor(rows.select(F.count_distinct(id_column)).scalar() * F.lit(share))


def sample_entities(rows: DataFrame, id_column: str, share: float) -> DataFrame:
    """All rows of a fixed-size sample of ids: the first ``share`` of the ids by hash, at least one."""
    wanted = F.greatest(F.lit(1).cast("bigint"), _share_of_ids(rows, id_column, share))
    chosen = ranked_ids(rows, id_column).filter(F.col("_rank") <= wanted).select(id_column)
    return rows.join(chosen, id_column, "left_semi")


def split_population(rows: DataFrame, id_column: str, first_share: float) -> DataFrame:
    """Every id with its group: the first ``first_share`` of the ids by hash are 1, the rest 2."""
    first = F.col("_rank") <= _share_of_ids(rows, id_column, first_share)
    return ranked_ids(rows, id_column).select(id_column, F.when(first, 1).otherwise(2).alias("population"))
