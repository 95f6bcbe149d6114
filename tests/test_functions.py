import pytest
from pyspark.sql import functions as F

from lotflow.functions import numbers as N
from lotflow.functions import text as X
from lotflow.functions import timeparts as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("pct, label", [
    (0.0, "EMPTY"), (0.1, "VERY LIGHT"), (9.99, "VERY LIGHT"), (10.0, "LIGHT"), (40.0, "MODERATE"), (70.0, "BUSY"),
    (89.9, "BUSY"), (90.0, "ALMOST FULL"), (99.9, "ALMOST FULL"), (100.0, "FULL"),
])
def test_judgement(spark, pct, label):
    assert value(spark, N.judgement(F.lit(pct))) == label


def test_rounding(spark):
    assert [value(spark, N.predicted_count(F.lit(x), F.lit(9))) for x in (0.5, 1.5, 2.5, -3.0, 40.0)] == [0, 2, 2, 0, 9]
    assert [value(spark, N.round_half_up(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [1, 2, 3, 0]
    assert value(spark, N.rate_pct(F.lit(0.12345))) == pytest.approx(12.34, abs=0.011)
    assert value(spark, N.predicted_share(F.lit(3), F.lit(0))) == 0.0


def test_unknown_capacity(spark):
    nothing = F.lit(None).cast("bigint")
    assert value(spark, N.is_peak(F.lit(5), nothing)) == 0
    assert value(spark, N.fill_pct(F.lit(5), F.lit(0))) == 0.0
    assert value(spark, N.occupancy_rate(F.lit(5), F.lit(0))) is None


def test_text(spark):
    assert value(spark, X.stay_text(F.lit(185.4))) == "3h 5m"
    assert value(spark, X.stay_text(F.lit(None).cast("double"))) == "0h 0m"
    assert value(spark, X.pct_text(F.lit(12.5))) == "13%"
    assert value(spark, X.hour_label(F.lit(7))) == "07:00"
    assert str(value(spark, X.day_in_path(F.lit("s3://x/NORTH/2024-01-31/f.parquet")))) == "2024-01-31"
    assert str(value(spark, X.day_in_path(F.lit("/lot_id=A/date=2024-01-31/f.parquet")))) == "2024-01-31"


def test_times(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    assert str(value(spark, P.previous_local_day(at("2024-01-10 07:59:00")))) == "2024-01-08"
    assert str(value(spark, P.previous_local_day(at("2024-01-10 08:00:00")))) == "2024-01-09"
    assert str(value(spark, P.grid_floor(at("2024-01-10 08:14:59")))) == "2024-01-10 08:00:00"
    assert str(value(spark, P.end_of_day(at("2024-01-10 08:14:59")))) == "2024-01-10 23:59:59"
    # A whole second has no fraction and so misses the strict layout.
    assert value(spark, P.strict_ts(F.lit("2024-01-10T08:00:00Z"))) is None
    assert value(spark, P.iso_ts(F.lit("2024-01-10T08:00:00Z"))) is not None
