"""Short-horizon forecasts: encode, split, train, score, store."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotflow.domain import HOLIDAYS, KEEP_PER_LOT, MODEL_FEATURES, SEMESTERS, as_dates
from lotflow.functions.numbers import predicted_count, predicted_share
from lotflow.functions.text import csv_row
from lotflow.functions.timeparts import day_of_week, grid_floor, hour_of_day, in_days, is_weekend, shift
from lotflow.operators.calendar import semester_dates
from lotflow.operators.merge import merge_forecast
from lotflow.plans.boosted_trees import BoostedTrees, fit_trees
from lotflow.schemas import FORECAST
from lotflow.sources.versions import read_latest, update

LOTS = [f.removeprefix("lot_id_") for f in MODEL_FEATURES if f.startswith("lot_id_")]
CAMPUSES = [f.removeprefix("campus_") for f in MODEL_FEATURES if f.startswith("campus_")]
FLAGS = ("is_holiday", "is_weekend", "is_exam_week")

# Settings of both boosted models.
GRID = timedelta(minutes=15)
ROUNDS, DEPTH, STEP, GAMMA, SUBSAMPLE, MIN_CHILD = 100, 5, 0.2, 4.0, 0.8, 6.0


def one_hot(rows: DataFrame) -> DataFrame:
    """0/1 columns over the declared lots and campuses; an unknown value is 0 everywhere."""
    lots = {f"lot_id_{v}": F.coalesce((F.col("lot_id") == v).cast("int"), F.lit(0)) for v in LOTS}
    campuses = {f"campus_{v}": F.coalesce((F.col("campus") == v).cast("int"), F.lit(0)) for v in CAMPUSES}
    return rows.withColumns({**lots, **campuses})


def model_matrix(rows: DataFrame) -> DataFrame:
    """Rows with all model inputs as numbers; an unknown flag counts as no."""
    flags = {f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in FLAGS}
    return one_hot(rows).withColumns(flags)


def in_training(key: Column) -> Column:
    """A fixed 80 % of the keys, by hash."""
    return F.substring(F.md5(key), 1, 4) < F.lit("cccd")


def row_key() -> Column:
    return F.concat_ws("|", F.col("lot_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm"))


def split(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    chosen = in_training(row_key())
    return features.filter(chosen), features.filter(~chosen)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=MODEL_FEATURES, outputCol="inputs")


def _train(features: DataFrame, label: str, prediction: str, objective: str, rounds: int) -> BoostedTrees:
    return fit_trees(model_matrix(features), ["lot_id", "timestamp"], MODEL_FEATURES, label, prediction, objective=objective, rounds=rounds,
                     depth=DEPTH, step=STEP, gamma=GAMMA, least=MIN_CHILD, subsample=SUBSAMPLE)


def train_occupancy(features: DataFrame, rounds: int = ROUNDS) -> BoostedTrees:
    """Boosted trees on squared error."""
    return _train(features, "occupancy_plus_15m", "occupancy_raw", "squared", rounds)


def train_departures(features: DataFrame, rounds: int = ROUNDS) -> BoostedTrees:
    """Boosted trees on the Poisson likelihood, with the settings of the occupancy model."""
    return _train(features, "departures_in_15m", "departures_raw", "poisson", rounds)


def train_both(features: DataFrame, rounds: int = ROUNDS) -> tuple[BoostedTrees, BoostedTrees]:
    """Both models; their jobs, which are many and short, run side by side."""
    with ThreadPoolExecutor(2) as pool:
        occupancy, departures = pool.submit(train_occupancy, features, rounds), pool.submit(train_departures, features, rounds)
        return occupancy.result(), departures.result()


def train_departures_linear(features: DataFrame) -> PipelineModel:
    """Poisson regression with a log link: a quick count model to compare with."""
    poisson = GeneralizedLinearRegression(featuresCol="inputs", labelCol="departures_in_15m",
                                          predictionCol="departures_raw", family="poisson", link="log",
                                          regParam=0.01, maxIter=25)
    return Pipeline(stages=[_assembler(), poisson]).fit(model_matrix(features))


def errors(rows: DataFrame, label: str, prediction: str) -> dict[str, float]:
    """Root of the mean squared error, mean error, and mean Poisson deviance (of predictions above 0; else null)."""
    y, mu = F.col(label).cast("double"), F.col(prediction).cast("double")
    surprise = F.when(y > 0, y * F.log(F.try_divide(y, mu))).otherwise(0.0)
    deviance = F.when(F.min(mu) > 0, F.avg(2 * (surprise - (y - mu))))
    return rows.agg(F.sqrt(F.avg((y - mu) * (y - mu))).alias("rmse"), F.avg(F.abs(y - mu)).alias("mae"), deviance.alias("deviance")).first().asDict()


def evaluate(model: PipelineModel | BoostedTrees, rows: DataFrame, label: str, prediction: str) -> dict[str, float]:
    return errors(model.transform(model_matrix(rows)).select(label, prediction), label, prediction)


def scoring_rows(current: DataFrame, as_of: str, semesters: list[tuple] = SEMESTERS,
                 holidays: list[str] = HOLIDAYS) -> DataFrame:
    """One input row per lot of the live snapshot, with the calendar functions used for training."""
    ts = F.lit(as_of).cast("timestamp")
    day = F.to_date(ts)
    # One date for all lots: its period is a scalar, not a join.
    period = semester_dates(current.sparkSession, semesters, holidays).filter(F.col("date") == day).select("period").scalar()
    rows = current.select("lot_id", F.col("campus_name").alias("campus"), "capacity",
                          F.col("current_occupancy").alias("occupancy_now"))
    timed = rows.withColumns({
        "day_of_week": day_of_week(day), "hour_of_day": hour_of_day(ts), "is_holiday": in_days(day, as_dates(holidays)),
        "is_weekend": is_weekend(day), "is_exam_week": period == "exam",
    })
    return model_matrix(timed).select("lot_id", "campus", "capacity", *MODEL_FEATURES)


def scoring_csv(rows: DataFrame) -> DataFrame:
    return rows.select("lot_id", csv_row(*[F.col(c) for c in MODEL_FEATURES]).alias("payload"))


def finish(scored: DataFrame, as_of: str) -> DataFrame:
    """Stored forecast rows: whole numbers, the share of the capacity, and times on the 15-minute grid."""
    run = grid_floor(F.lit(as_of).cast("timestamp"))
    count = predicted_count(F.col("occupancy_raw"), F.col("capacity"))
    return scored.select(
        "lot_id", shift(run, minutes=15).alias("forecast_time"), run.alias("run_time"),
        count.alias("predicted_occupancy_count"),
        predicted_count(F.col("departures_raw")).alias("predicted_num_departures"),
        predicted_share(count, F.col("capacity")).alias("predicted_occupancy_pct"),
    )


def forecast(current: DataFrame, occupancy: BoostedTrees, departures: PipelineModel | BoostedTrees, as_of: str, **calendar) -> DataFrame:
    """Both predictions for every lot, 15 minutes ahead; one frame runs through both models, so rows keep their key."""
    rows = scoring_rows(current, as_of, **calendar)
    return finish(departures.transform(occupancy.transform(rows)), as_of)


def forecast_cycle(current: DataFrame, occupancy: BoostedTrees, departures: PipelineModel | BoostedTrees, as_of: str, root: str,
                   **calendar) -> None:
    """One scheduled run: score, replace by (lot, target time), keep the newest runs per lot."""
    new = forecast(current, occupancy, departures, as_of, **calendar)
    update(current.sparkSession, root, FORECAST, lambda old: merge_forecast(old, new, KEEP_PER_LOT))


def store_models(spark: SparkSession, occupancy: BoostedTrees, departures: BoostedTrees, path: str) -> None:
    occupancy.save(spark, f"{path}/occupancy")
    departures.save(spark, f"{path}/departures")


def run_forecast(spark: SparkSession, current: DataFrame, models: str, as_of: str, root: str, **calendar) -> None:
    """The job of every 15 minutes: load both stored models, score the snapshot, merge the forecasts."""
    occupancy, departures = (BoostedTrees.load(spark, f"{models}/{m}") for m in ("occupancy", "departures"))
    forecast_cycle(current, occupancy, departures, as_of, root, **calendar)


def due_times(last: datetime | None, now: datetime) -> list[datetime]:
    """Grid times after the last run up to now; without a run before, the newest one."""
    newest = now.replace(minute=now.minute // 15 * 15, second=0, microsecond=0)
    if last is None:
        return [newest]
    return [last + GRID * k for k in range(1, max(0, (newest - last) // GRID) + 1)]


def schedule_forecasts(spark: SparkSession, snapshot: Callable[[datetime], DataFrame], models: str, root: str, checkpoint: str,
                       every: str = "15 minutes", clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None),
                       **calendar) -> StreamingQuery:
    """Forecasts at every grid time: a stream of ticks, each of which makes the runs that are due by ``clock``.

    What is due follows from the newest run that is stored, so runs missed while the job stood still are made up for, in order and
    once, and a tick that is handed over again finds nothing to do.  ``snapshot(time)`` gives the live state to score.  Models are loaded once.
    """
    occupancy, departures = (BoostedTrees.load(spark, f"{models}/{m}") for m in ("occupancy", "departures"))

    def on_tick(_: DataFrame, __: int) -> None:
        last = read_latest(spark, root, FORECAST).agg(F.date_format(F.max("run_time"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        for due in due_times(datetime.fromisoformat(last) if last else None, clock()):
            forecast_cycle(snapshot(due), occupancy, departures, due.isoformat(" "), root, **calendar)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
