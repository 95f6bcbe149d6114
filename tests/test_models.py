from pyspark.sql import functions as F

from lotflow.domain import MODEL_FEATURES
from lotflow.fixtures import CALENDAR
from lotflow.plans import forecast as P
from lotflow.plans.boosted_trees import BoostedTrees
from lotflow.schemas import FORECAST
from lotflow.session import shared_dir
from lotflow.sources.versions import read_latest


def test_fit_score_and_store(spark, given):
    path = shared_dir(spark, "training")
    given.features.write.parquet(path)
    features = spark.read.parquet(path)
    train, validation = P.split(features)
    assert train.count() + validation.count() == features.count()
    assert 0.75 < train.count() / features.count() < 0.85
    occupancy, departures = P.train_both(train, rounds=25)
    # Better than "no change".
    fit = P.evaluate(occupancy, validation, "occupancy_plus_15m", "occupancy_raw")
    naive = P.errors(validation, "occupancy_plus_15m", "occupancy_now")
    assert fit["rmse"] < naive["rmse"]
    counts = P.evaluate(departures, validation, "departures_in_15m", "departures_raw")
    # Steps are short on the log scale: 25 of the 100 rounds don't come down from the first prediction to the mean count.
    first = P.errors(validation.withColumn("m", F.lit(0.5)), "departures_in_15m", "m")
    assert counts["rmse"] < first["rmse"] and counts["deviance"] < first["deviance"]
    kept = shared_dir(spark, "model")
    P.store_models(spark, occupancy, departures, kept)
    again = BoostedTrees.load(spark, f"{kept}/departures")
    assert P.evaluate(again, validation, "departures_in_15m", "departures_raw") == counts
    root = shared_dir(spark, "forecasts")
    for as_of in ("2024-01-30 00:02:00", "2024-01-30 00:14:00", "2024-01-30 00:15:00"):
        P.forecast_cycle(given.current, occupancy, departures, as_of, root, **CALENDAR)
    rows = read_latest(spark, root, FORECAST).join(given.capacity, "lot_id").collect()
    # The second run falls on the same grid time as the first and replaces it.
    assert len(rows) == 2 * 7
    assert all(0 <= r["predicted_occupancy_count"] <= r["capacity"] and r["predicted_num_departures"] >= 0 for r in rows)
    assert all(0.0 <= r["predicted_occupancy_pct"] <= 1.0 for r in rows)


def test_unknown_lot_is_zero_everywhere(spark):
    rows = spark.createDataFrame([("NOWHERE", "MOON")], "lot_id string, campus string")
    encoded = P.one_hot(rows).first().asDict()
    assert sum(v for k, v in encoded.items() if k in MODEL_FEATURES) == 0


def test_scoring_rows_use_the_training_calendar(given):
    row = P.scoring_rows(given.current, "2024-01-15 10:00:00", **CALENDAR).first()
    assert (row["is_holiday"], row["is_weekend"], row["day_of_week"], row["hour_of_day"]) == (1, 0, 2, 10)
