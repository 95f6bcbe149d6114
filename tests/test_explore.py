
from lotflow.operators import explore as X


def test_histogram_keeps_all_rows_and_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(v,) for v in [0, 0, 5, 10, 10, None]], "v bigint")
    assert [(r["bin"], r["n"]) for r in X.histogram(rows, "v", 2).orderBy("bin").collect()] == [(1, 2), (2, 3)]


def test_histogram_of_one_value(spark):
    rows = spark.createDataFrame([(3,)] * 4, "v bigint")
    counts = [r["n"] for r in X.histogram(rows, "v", 4).orderBy("bin").collect()]
    assert sum(counts) == 4 and counts[2] == 4


def test_flags_count_nulls(spark):
    rows = spark.createDataFrame([(True, None, False), (False, None, False)], "is_holiday boolean, is_weekend boolean, is_exam_week boolean")
    found = {(r["flag"], r["value"]): r["n"] for r in X.flag_value_counts(rows).collect()}
    assert found == {("is_holiday", "true"): 1, ("is_holiday", "false"): 1, ("is_weekend", "null"): 2, ("is_exam_week", "false"): 2}
    nulls = {r["column_name"]: r["nulls"] for r in X.null_counts(rows).collect()}
    assert nulls == {"is_holiday": 0, "is_weekend": 2, "is_exam_week": 0}


def test_quality_of_the_feature_table(given):
    nulls = {r["column_name"]: r["nulls"] for r in X.null_counts(given.features).collect()}
    assert {c for c, n in nulls.items() if n} <= {"is_exam_week"}
