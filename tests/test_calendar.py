from datetime import date

from pyspark.sql import functions as F

from lotflow.operators import calendar as C

TERM = [("T", "2024-01-02", "2024-01-20", "2024-01-27")]


def days_of(spark, *days):
    return spark.createDataFrame([(date.fromisoformat(d),) for d in days], "date date")


def test_periods(spark):
    wanted = {"2024-01-01": "out", "2024-01-02": "busy", "2024-01-06": "off_day", "2024-01-15": "off_day",
              "2024-01-16": "regular", "2024-01-19": "regular", "2024-01-22": "exam", "2024-01-28": "out"}
    rows = C.classify_period(days_of(spark, *wanted), TERM, ["2024-01-15"]).collect()
    assert {str(r["date"]): r["period"] for r in rows} == wanted


def test_default_semesters_do_not_overlap(spark):
    dates = C.semester_dates(spark)
    assert dates.count() == dates.select("date").distinct().count()


def test_template_by_number_and_by_letter(spark):
    template = spark.createDataFrame([("1", 2, "T"), ("2", 4, "Th")], "student_id string, weekday int, day string")
    exact = C.expand_weekly_template(template, "2024-01-01", "2024-01-07").collect()
    assert sorted((r["student_id"], r["date"].day) for r in exact) == [("1", 2), ("2", 4)]
    loose = C.expand_weekly_template(template, "2024-01-01", "2024-01-07", by_letter=True).collect()
    assert sorted((r["student_id"], r["date"].day) for r in loose) == [("1", 2), ("1", 4), ("2", 2), ("2", 4)]


def test_disagreeing_flags_of_a_date_give_true(spark):
    rows = [(date(2024, 1, 1), True, False, None, False, False), (date(2024, 1, 1), False, False, None, False, False)]
    history = spark.createDataFrame(rows, "date date, " + ", ".join(f"{f} boolean" for f in C.FLAG_NAMES))
    assert C.calendar_of(history).collect() == [(date(2024, 1, 1), True, False, None, False, False)]


def test_sample_and_split_sizes(spark):
    rows = spark.range(1000).select((F.col("id") % 50).cast("string").alias("student_id"))
    assert C.sample_entities(rows, "student_id", 0.12).select("student_id").distinct().count() == 6
    assert C.sample_entities(rows, "student_id", 0.001).select("student_id").distinct().count() == 1
    sizes = C.split_population(rows, "student_id", 0.4).groupBy("population").count().collect()
    assert {r["population"]: r["count"] for r in sizes} == {1: 20, 2: 30}
