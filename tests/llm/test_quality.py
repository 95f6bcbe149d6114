"""The classifier on labels it has not seen, and the votes against a plain loop."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotflow.llm.quality import fit, held_out, score, vote


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(docs, labels):
    scored = score(docs, fit(docs, labels)).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    rows = scored.select("quality", "quality_score").collect()
    right = sum((r["quality_score"] >= 0.5) == bool(r["quality"]) for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


def test_held_out_labels_are_not_learned(spark, docs, labels):
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs, turned)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all() and len(a.labels) > 100
    few = fit(docs, labels, sample=50)
    assert len(few.labels) == 50


def test_votes_against_a_loop():
    draw = np.random.default_rng(1)
    known = draw.standard_normal((40, 5))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels = draw.integers(0, 2, 40).astype(float)
    asked = np.vstack((known[:5], np.zeros((1, 5)), known[20:30] * -1))
    found = vote(asked, known, labels, 7, block=3)
    for x, got in zip(asked, found):
        near = sorted(((k @ x, y) for k, y in zip(known, labels)), reverse=True)[:7]
        weight = [max(c, 0.0) ** 2 for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if sum(weight) else labels.mean()
        assert got == pytest.approx(want)


def test_edges(spark, docs, labels):
    voter = fit(docs, labels)
    schema = "doc_id long, text string, quality_score string, label int, terms int"
    odd = spark.createDataFrame([(None, None, "a", 1, 1), (1, "", "b", 1, 1), (1, "", "b", 1, 1), (2, "word " * 300_000, "c", 1, 1), (3, "|", "d", 1, 1)], schema)
    rows = score(odd, voter).collect()
    assert len(rows) == 5 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert rows[0]["quality_score"] == rows[1]["quality_score"] == pytest.approx(voter.labels.mean())
    none = fit(docs, labels.limit(0))
    assert {r["quality_score"] for r in score(odd, none).collect()} == {0.5}
    assert score(odd.limit(0), voter).count() == 0


def test_the_term_matrix_stays_off_the_driver(spark):
    """1,500 rows of 2,072 terms are 12 MB in single precision; the driver's Python holds the basis and the vectors only."""
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words of {i} and {i * i}, {i % 7} lines") for i in range(2300)], schema)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    fit(docs.limit(10), labels)
    tracemalloc.start()
    voter = fit(docs, labels)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(voter.labels) > 1400 and voter.vectors.shape[1] == voter.basis.shape[1] == 64
    assert peak < 8e6
