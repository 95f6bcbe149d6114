"""Failed records of the live job, handed back and sent again."""

import base64
import json
from pathlib import Path

from lotflow.session import shared_dir
from lotflow.sources.events import capacity_table
from lotflow.streaming import jobs as J
from lotflow.streaming.replay import failed_positions, send_again

AS_OF = "2024-01-11 00:00:00"


def data(i, kind="ARRIVAL"):
    row = {"session_id": f"s{i}", "timestamp": f"2024-01-10T10:{i:02d}:00.000000Z", "event_type": kind, "lot_id": "EAST", "campus": "BURNABY",
           "student_id": "1", "plate_number": "P"}
    return base64.b64encode(json.dumps(row).encode()).decode()


def test_two_of_ten_fail_and_each_counts_once(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", shared_dir(spark, "live"), shared_dir(spark, "checkpoint")
    inbox.mkdir()
    sent = {i: data(i) for i in range(10)} | {3: "{broken", 7: data(7, "NOTHING")}
    lines = [{"event_id": i, "data": d} for i, d in sent.items()] + [{"event_id": 3, "data": "{broken"}, {"event_id": None, "data": "{lost"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    capacity = capacity_table(spark, {"BURNABY": {"EAST": 50}})

    def run():
        J.live(J.read_sent(spark, str(inbox)), capacity, AS_OF, root, checkpoint).awaitTermination()
        counted = [r["event_id"] for r in spark.read.parquet(f"{root}/new").select("event_id").collect()]
        return sorted(counted), {r["event_id"]: r["attempts"] for r in failed_positions(spark, root).collect()}

    assert run() == ([0, 1, 2, 4, 5, 6, 8, 9], {3: 2, 7: 1, None: 1})
    # The sender holds all ten, and mends one; exactly the failed ones are written.
    held = spark.createDataFrame([(i, data(i) if i != 7 else sent[7], 1) for i in range(10)], "event_id long, data string, attempts int")
    folder = send_again(held, failed_positions(spark, root), str(inbox))
    assert sorted(r["event_id"] for r in spark.read.json(folder).collect()) == [3, 7]
    assert run() == ([0, 1, 2, 3, 4, 5, 6, 8, 9], {7: 2, None: 1})
    # Sent again with all others, and twice: each still counts once.
    everything = spark.range(10).selectExpr("id as event_id", "1L as attempts")
    mended = spark.createDataFrame([(i, data(i)) for i in range(10)], "event_id long, data string")
    assert spark.read.schema("event_id long").json(send_again(mended, failed_positions(spark, root), shared_dir(spark, "none"), most=2)).isEmpty()
    for _ in range(2):
        send_again(mended, everything, str(inbox))
    assert run() == (list(range(10)), {None: 1})


def test_no_job_has_no_failed_position(spark):
    assert failed_positions(spark, shared_dir(spark, "none")).isEmpty()


def test_records_are_decoded_once_and_landed_batches_followed(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", shared_dir(spark, "live"), shared_dir(spark, "checkpoint")
    inbox.mkdir()
    for i in range(3):
        lines = [{"event_id": i, "data": data(i)}, {"event_id": 0, "data": data(0)}, {"event_id": 10 + i, "data": "{broken"}]
        (inbox / f"{i}.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    capacity = capacity_table(spark, {"BURNABY": {"EAST": 50}})
    job = J.live(J.read_sent(spark, str(inbox), files_per_batch=1), capacity, AS_OF, root, checkpoint)
    job.awaitTermination()
    assert not any(query.isActive for query in job.queries)
    # The second stream has read what the first one landed, and no record as sent.
    read = "".join(p.read_text() for p in Path(f"{checkpoint}/once/sources/0").iterdir() if p.name.isdigit())
    assert "/landed/stream=" in read and str(inbox) not in read
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{root}/new").collect()) == [0, 1, 2]
    landed = lambda: sorted(r["event_id"] for r in spark.read.parquet(f"{root}/landed").select("event_id").collect())
    assert landed() == [0, 0, 0, 0, 1, 2] and spark.read.parquet(f"{root}/bad").count() == 3
    # A batch that has landed keeps its files when it is run again.
    (stream,) = (Path(root) / "landed").iterdir()
    assert sorted(p.name for p in stream.iterdir()) == ["batch=0", "batch=1", "batch=2"]
    files = sorted(p.name for p in stream.rglob("*.parquet"))
    J._intake(root, f"{checkpoint}/intake")(J.checked(J.decode_events(spark.createDataFrame([], J.SENT)), AS_OF), 1)
    assert sorted(p.name for p in stream.rglob("*.parquet")) == files and landed() == [0, 0, 0, 0, 1, 2]
