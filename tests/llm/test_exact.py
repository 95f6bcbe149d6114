"""Exact duplicates against a plain grouping, through the stream."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotflow.llm import exact_dedup as E

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "long " * 200_000), (9, "long " * 200_000), (10, "a"),
        (10, "a"), (None, "a"), (None, "only"), (11, "ü"), (12, "ü"), (13, "b\n")]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, digest string, length int").repartition(5).write.parquet(path)
    return path


def expected():
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


@pytest.mark.parametrize("files", [1, 8])
def test_against_grouping(spark, folder, files):
    found = E.exact_duplicates(spark, folder, files)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected()


def test_equal_digests_of_different_texts(spark, folder, monkeypatch):
    monkeypatch.setattr(E, "digest", lambda text: F.lit("same"))
    found = E.exact_duplicates(spark, folder).collect()
    # Only the digest column is not what it should be.
    cut = lambda rows: sorted(str(r).rsplit(",", 1)[0] for r in rows)
    assert cut(str(tuple(r)) for r in found) == cut(expected())


def test_a_file_and_no_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["x", "x"]}), path)
    assert sorted(tuple(r)[:4] for r in E.exact_duplicates(spark, path).collect()) == [(1, 2, 2, False), (2, 2, 2, True)]
    empty = str(tmp_path / "empty.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), empty)
    assert E.exact_duplicates(spark, empty).count() == 0


def test_kept_rows_that_are_not_found_again(spark, folder, monkeypatch):
    """Without a text to compare with, groups of several are grouped by their texts, though their digests are equal."""
    state = E.latest_state
    monkeypatch.setattr(E, "digest", lambda text: F.lit("same"))
    monkeypatch.setattr(E, "latest_state", lambda *a: state(*a).withColumn("row", F.col("row") + 1_000_000))
    cut = lambda rows: sorted(str(r).rsplit(",", 1)[0] for r in rows)
    assert cut(str(tuple(r)) for r in E.exact_duplicates(spark, folder).collect()) == cut(expected())
