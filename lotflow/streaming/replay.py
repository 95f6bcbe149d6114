"""Failed records handed back by their position, and sent again: exactly those, each counted once.

The live job keeps every record that it can't take in ``bad``, with the position the stream gave it.  A position has failed as long
as no record of it has landed; a sender asks for the failed positions, and what is sent again goes through the live job like
any other record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.session import shared_dir
from lotflow.sources.events import read_or_empty

POSITION = T.StructType([T.StructField("event_id", T.LongType())])
BAD = T.StructType([*POSITION.fields, T.StructField("reason", T.StringType())])


def failed_positions(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, reasons, attempts) of every position below a live job's ``root`` of which records have failed and none has landed.

    ``reasons`` are its different reasons in order (there are as many as rules), ``attempts`` how often it failed.  Records without a position are one row without.
    Of what has landed only positions that failed are kept, before anything is compared.
    """
    bad = read_or_empty(spark, f"{root}/bad", BAD).groupBy("event_id").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"), F.count(F.lit(1)).alias("attempts"))
    landed = read_or_empty(spark, f"{root}/landed", POSITION).select("event_id")
    return bad.join(landed.join(bad.select("event_id"), "event_id", "left_semi").distinct(), "event_id", "left_anti")


def send_again(records: DataFrame, failed: DataFrame, path: str, most: int | None = None) -> str:
    """Write those of ``records(event_id, data)`` whose position has failed, less than ``most`` times if given, into a new folder below
    ``path``, and return it.

    A stream over ``path`` takes the folder's files up once they are committed.  Sent twice, they still count once; records without
    a position are never sent again.
    """
    wanted = failed if most is None else failed.filter(F.col("attempts") < most)
    folder = f"{path}/{shared_dir(records.sparkSession, 'again').rsplit('/', 1)[1]}"
    records.select("event_id", "data").join(wanted.select("event_id"), "event_id", "left_semi").write.json(folder)
    return folder
