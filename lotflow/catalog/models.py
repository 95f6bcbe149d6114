"""Features, models and forecasts."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.catalog.storage import exported
from lotflow.fixtures import AS_OF, CALENDAR, HOLIDAYS
from lotflow.plans import forecast as P
from lotflow.plans.features import run_features, run_features_of_days
from lotflow.schemas import FORECAST, WIRE
from lotflow.session import shared_dir
from lotflow.sources import events as E
from lotflow.sources import sinks as K
from lotflow.sources.versions import read_latest

FEATURES_SQL = """select lot_id, campus, timestamp, occupancy_now, day_of_week, hour_of_day, cast(is_holiday as varchar) as is_holiday,
    cast(is_weekend as varchar) as is_weekend, cast(is_exam_week as varchar) as is_exam_week, occupancy_plus_15m, departures_in_15m from features"""


def stored_logs(g) -> tuple[str, str]:
    """The folders of the converted export and of the landed live events."""
    history = g.once("historical", lambda p: K.convert_export(E.read_export(g.spark, exported(g)), p))
    day = F.to_date(F.substring("timestamp", 1, 10))
    landed = g.once("landed-live", lambda p: K.write_landed(g.live.select(*WIRE.fieldNames()).withColumn("date", day), p))
    return history, landed


@query("training_features", FEATURES_SQL)
def _(g):
    """From the stored logs, which carry no event ids, to the stored feature table."""
    out = shared_dir(g.spark, "feature-table")
    run_features(g.spark, *stored_logs(g), out, HOLIDAYS)
    return g.spark.read.parquet(out)


@query("nightly_features", FEATURES_SQL)
def _(g):
    """The same table, brought up to date history and all but two live days at first, then two single nights, then the first live day again."""
    store, logs = shared_dir(g.spark, "features"), stored_logs(g)
    dates = lambda log: [str(r["date"]) for r in log.select("date").distinct().orderBy("date").collect()]
    live = dates(E.read_or_empty(g.spark, logs[1], E.LANDED))
    for days in (sorted({*dates(g.historical), *live[:-2]}), live[-2:-1], live[-1:], live[:1]):
        run_features_of_days(g.spark, *logs, store, days, HOLIDAYS)
    return g.spark.read.parquet(f"{store}/features").drop("date")


ONE_HOT_SQL = ", ".join([f"cast(lot_id = '{v}' as int) as lot_id_{v}" for v in P.LOTS]
                        + [f"cast(campus = '{v}' as int) as campus_{v}" for v in P.CAMPUSES])


@query("one_hot", f"select lot_id, timestamp, {ONE_HOT_SQL} from features")
def _(g):
    names = [f"lot_id_{v}" for v in P.LOTS] + [f"campus_{v}" for v in P.CAMPUSES]
    return P.one_hot(g.stored("features")).select("lot_id", "timestamp", *names)


@query("train_val_split", """select lot_id, timestamp, case when substr(md5(lot_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M')), 1, 4) < 'cccd'
    then 'train' else 'validation' end as part from features""")
def _(g):
    train, validation = P.split(g.stored("features"))
    keep = lambda rows, part: rows.select("lot_id", "timestamp", F.lit(part).alias("part"))
    return keep(train, "train").unionByName(keep(validation, "validation"))


SCORE_SQL = f"""select lot_id, campus_name as campus, capacity, current_occupancy as occupancy_now, 3 as day_of_week, 0 as hour_of_day, 0 as is_holiday,
    0 as is_weekend, 0 as is_exam_week, {ONE_HOT_SQL.replace("cast(campus = ", "cast(campus_name = ")} from current"""


@query("score_current", SCORE_SQL)
def _(g):
    return P.scoring_rows(g.stored("current"), AS_OF, **CALENDAR)


@query("feature_csv_row", "select lot_id, current_occupancy || ',3,0,0,0,0,' || "
       + " || ',' || ".join([f"cast(lot_id = '{v}' as int)" for v in P.LOTS] + [f"cast(campus_name = '{v}' as int)" for v in P.CAMPUSES])
       + " as payload from current")
def _(g):
    return P.scoring_csv(P.scoring_rows(g.stored("current"), AS_OF, **CALENDAR))


#: Models fitted once per session and table set, and shared by the queries below.
_fitted: dict[tuple[str, str], tuple] = {}


def _models(g):
    """Both models on the stored feature table, so that every round reads files and not the whole lineage."""
    key = (g.spark.sparkContext.applicationId, g.dir)
    if key not in _fitted:
        train, validation = P.split(g.stored("features"))
        _fitted[key] = *P.train_both(train), validation
    return _fitted[key]


def _bounds(rows):
    """What is determined of a forecast: its key and times, and that its numbers are within their bounds."""
    count, capacity = F.col("predicted_occupancy_count"), F.col("capacity")
    share = F.bround(count.cast("double") / capacity.cast("double"), 2)
    return rows.select("lot_id", "forecast_time", "run_time", count.between(0, capacity).alias("count_in_bounds"),
                       (F.abs(F.col("predicted_occupancy_pct") - share) < 1e-9).alias("share_of_capacity"),
                       (F.col("predicted_num_departures") >= 0).alias("departures_counted"))


BOUNDS_SQL = "'true' as count_in_bounds, 'true' as share_of_capacity, 'true' as departures_counted"


@query("forecast", f"""select lot_id, timestamp '2024-01-30 00:15:00' as forecast_time, timestamp '2024-01-30 00:00:00' as run_time,
    {BOUNDS_SQL} from current""")
def _(g):
    occupancy, departures, _ = _models(g)
    rows = P.forecast(g.stored("current"), occupancy, departures, AS_OF, **CALENDAR)
    return _bounds(rows.join(g.capacity.select("lot_id", "capacity"), "lot_id"))


@query("forecast_cycle", f"""select lot_id, run_time + interval 15 minutes as forecast_time, run_time, {BOUNDS_SQL} from current,
    (values (timestamp '2024-01-30 00:00:00'), (timestamp '2024-01-30 00:15:00'), (timestamp '2024-01-30 00:30:00')) r(run_time)""")
def _(g):
    # The last two runs fall on the same grid time; for the last one both models are stored and loaded again.
    occupancy, departures, _ = _models(g)
    models, root = shared_dir(g.spark, "models"), shared_dir(g.spark, "forecasts")
    for minute in ("00:02:00", "00:15:30", "00:31:00"):
        P.forecast_cycle(g.stored("current"), occupancy, departures, f"2024-01-30 {minute}", root, **CALENDAR)
    P.store_models(g.spark, occupancy, departures, models)
    P.run_forecast(g.spark, g.stored("current"), models, "2024-01-30 00:44:00", root, **CALENDAR)
    rows = read_latest(g.spark, root, FORECAST)
    return _bounds(rows.join(g.capacity.select("lot_id", "capacity"), "lot_id"))


#: The rows that no model has learned from.
VALIDATION_SQL = "from features where substr(md5(lot_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M')), 1, 4) >= 'cccd'"


def _finite(name: str):
    x = F.col(name)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


@query("train_occupancy", f"select lot_id, timestamp, occupancy_plus_15m, 'true' as finite {VALIDATION_SQL}")
def _(g):
    occupancy, _, validation = _models(g)
    scored = occupancy.transform(P.model_matrix(validation))
    return scored.select("lot_id", "timestamp", "occupancy_plus_15m", _finite("occupancy_raw").alias("finite"))


COUNT_SQL = f"select lot_id, timestamp, departures_in_15m, 'true' as finite, 'true' as not_negative {VALIDATION_SQL}"


def _counts(scored):
    return scored.select("lot_id", "timestamp", "departures_in_15m", _finite("departures_raw").alias("finite"),
                         (F.col("departures_raw") >= 0).alias("not_negative"))


@query("train_departures", COUNT_SQL)
def _(g):
    _, departures, validation = _models(g)
    return _counts(departures.transform(P.model_matrix(validation)))


@query("train_departures_linear", COUNT_SQL)
def _(g):
    train, validation = P.split(g.stored("features"))
    return _counts(P.train_departures_linear(train).transform(P.model_matrix(validation)))


@query("evaluate", f"""select model, metric, case when model = 'no change' then case metric when 'rmse' then rmse else mae end end as value,
    'true' as finite, n_rows from (select count(*) as n_rows, sqrt(avg(gap * gap)) as rmse, avg(gap) as mae
        from (select cast(abs(occupancy_plus_15m - occupancy_now) as double) as gap {VALIDATION_SQL})),
    (values ('no change'), ('occupancy'), ('departures')) m(model), (values ('rmse'), ('mae')) k(metric)""")
def _(g):
    """The errors of "no change" as they are; of the models' errors, that they are numbers from 0 on."""
    occupancy, departures, validation = _models(g)
    scores = {
        "occupancy": P.evaluate(occupancy, validation, "occupancy_plus_15m", "occupancy_raw"),
        "departures": P.evaluate(departures, validation, "departures_in_15m", "departures_raw"),
    }
    learned = validation.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.lit(found[metric]).alias(f"{model}|{metric}") for model, found in scores.items() for metric in ("rmse", "mae")])
    gap = F.abs(F.col("occupancy_plus_15m") - F.col("occupancy_now")).cast("double")
    naive = validation.agg(F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(gap * gap)).alias("no change|rmse"),
                           F.avg(gap).alias("no change|mae"))

    def long(wide):
        names = [c for c in wide.columns if c != "n_rows"]
        split = F.split("name", r"\|")
        return wide.unpivot(["n_rows"], names, "name", "value").select(
            split.getItem(0).alias("model"), split.getItem(1).alias("metric"), "value", "n_rows")

    rows = long(learned).unionByName(long(naive))
    return rows.select("model", "metric", F.when(F.col("model") == "no change", F.col("value")).alias("value"),
                       (_finite("value") & (F.col("value") >= 0)).alias("finite"), "n_rows")


@query("forecast_values")
def _(g):
    """The forecast as it is stored; what a model has learned can't be stated in SQL."""
    occupancy, departures, _ = _models(g)
    return P.forecast(g.stored("current"), occupancy, departures, AS_OF, **CALENDAR)


@query("predictions")
def _(g):
    """What both models predict for the rows that they haven't learned from, beside what came."""
    occupancy, departures, validation = _models(g)
    scored = departures.transform(occupancy.transform(P.model_matrix(validation)))
    return scored.select("lot_id", "timestamp", "occupancy_now", "occupancy_plus_15m", F.col("occupancy_raw").alias("predicted_occupancy"),
                         "departures_in_15m", F.col("departures_raw").alias("predicted_departures"))


@query("model_errors")
def _(g):
    """The errors on these rows, beside those of two plain guesses: no change, and the mean of the learned rows."""
    occupancy, departures, validation = _models(g)
    train, _ = P.split(g.stored("features"))
    mean = train.select(F.avg("departures_in_15m").alias("m")).scalar()
    scored = departures.transform(occupancy.transform(P.model_matrix(validation))).withColumn("mean", mean)
    compared = [("occupancy", "learned", "occupancy_plus_15m", "occupancy_raw"), ("occupancy", "no change", "occupancy_plus_15m", "occupancy_now"),
                ("departures", "learned", "departures_in_15m", "departures_raw"), ("departures", "mean", "departures_in_15m", "mean")]
    rows = [(label, guess, *P.errors(scored, y, p).values()) for label, guess, y, p in compared]
    return g.spark.createDataFrame(rows, "label string, guess string, rmse double, mae double, deviance double")
