import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lotflow.session import local_session, prepare  # noqa: E402

EVENTS = ("event_id bigint, session_id string, event_ts timestamp, event_type string, lot_id string, campus string, "
          "student_id string, plate_number string")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from (session, 'YYYY-MM-DD HH:MM:SS[.f]', 'A' or 'D' or a type, lot) tuples, ids in list order."""
    from pyspark.sql import functions as F

    def build(rows):
        names = {"A": "ARRIVAL", "D": "DEPARTURE"}
        full = [(i, s, datetime.fromisoformat(t) if t else None, names.get(k, k), lot,
                 "SURREY" if lot.startswith("SRY") else "BURNABY", "1", "P1") for i, (s, t, k, lot) in enumerate(rows)]
        return spark.createDataFrame(full, EVENTS).withColumn("date", F.to_date("event_ts"))

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    from lotflow.fixtures import Given

    return Given(spark, sf_dir)
