"""Window functions and running state."""

from pyspark.sql import functions as F

from lotflow.catalog.base import query
from lotflow.operators import grid as G
from lotflow.operators import occupancy as O
from lotflow.operators.serving import newest_per_lot, recent_events


@query("daily_running_occupancy", """select event_id, lot_id, event_ts, cast(sum(case when event_type = 'ARRIVAL' then 1 else -1 end)
    over (partition by lot_id, date order by event_ts) as bigint) as current_occupancy from pe_min""")
def _(g):
    return O.daily_running_occupancy(g.pe_min).select("event_id", "lot_id", "event_ts", "current_occupancy")


ROWS_SQL = """select event_id, lot_id, event_ts, cast(sum(case when event_type = 'ARRIVAL' then 1 else -1 end)
    over (partition by lot_id, cast(event_ts as date) order by event_ts, event_id rows unbounded preceding) as bigint) as occupancy_now from pe_min"""


@query("running_occupancy_rows", ROWS_SQL)
def _(g):
    return O.running_occupancy_rows(g.pe_min).select("event_id", "lot_id", "event_ts", "occupancy_now")


@query("forward_fill", "select lot_id, campus, w as window_start, occ as occupancy_now, cast(exam as varchar) as is_exam_week from filled")
def _(g):
    filled = G.forward_fill(G.fill_grid(g.stored("cells")), "occupancy_now", "is_exam_week")
    return filled.fillna(0, subset=["occupancy_now"]).select("lot_id", "campus", "window_start", "occupancy_now", "is_exam_week")


@query("recent_events_topk", "select * from recent")
def _(g):
    return recent_events(g.pe)


@query("forecast_retention", "select * from forecasts qualify row_number() over (partition by lot_id order by run_time desc) <= 5")
def _(g):
    return newest_per_lot(g.stored("forecasts"), "run_time", 5)


@query("clamped_occupancy", """select lot_id, event_ts, event_id, occupancy from (select lot_id, unnest(ts) as event_ts, unnest(ids) as event_id,
    unnest(path[2:]) as occupancy from (select lot_id, ts, ids, list_reduce(list_prepend([0], list_transform(d, lambda x: [x])),
    lambda a, x: list_append(a, greatest(0, least(capacity, a[len(a)] + x[1])))) as path
    from (select lot_id, list(event_ts order by event_ts, event_id) as ts, list(event_id order by event_ts, event_id) as ids,
        list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d from pe group by 1) join capacity using (lot_id)))""")
def _(g):
    return O.clamped_occupancy(g.pe, g.capacity)


@query("current_occupancy", "select * from snapshot")
def _(g):
    return O.current_occupancy(g.pe, g.capacity)


@query("daily_counts", """select lot_id, cast(date as varchar) as date, list_reduce(d, lambda a, x: greatest(0, least(capacity, a + x)), 0) as occupancy
    from (select lot_id, date, list(case when event_type = 'ARRIVAL' then 1 else -1 end order by event_ts, event_id) as d from pe group by 1, 2)
    join capacity using (lot_id)""")
def _(g):
    return O.daily_counts(g.pe, g.capacity)


@query("next_window_value", """select lot_id, campus, w as window_start, occ as occupancy_now,
    coalesce(lead(occ) over (partition by lot_id, campus order by w), -1) as next_value from filled""")
def _(g):
    grid = g.stored("features").select("lot_id", "campus", F.col("timestamp").alias("window_start"), "occupancy_now")
    return G.next_window_value(grid, "occupancy_now", "next_value").withColumn("next_value", F.coalesce("next_value", F.lit(-1)))
