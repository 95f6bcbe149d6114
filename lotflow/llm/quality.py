"""A quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.llm.common import flat_texts, hash_sample, mixed, prepare, word_hashes

#: Columns of the term matrix: hashed runs of four character classes, hashed words, and steps of three shares.
RUNS, WORDS, STEPS = 1024, 1024, 8
TERMS = RUNS + WORDS + 3 * STEPS
#: Class of each byte: letters, capitals, digits, kinds of space, and each common sign by itself.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _code, _sign in enumerate(" \n.,|*#%&$", 4):
    _CLASS[ord(_sign)] = _code


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit row of TERMS per text (zero for a text without characters): 1 + log of each term's count.

    Beside runs and words there are steps for the share of words that repeat the one before, of distinct words, and
    of characters that are neither letter nor space.
    """
    n, length = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), length)
    kind = _CLASS[data].astype(np.int64)
    rows = np.zeros((n, TERMS))
    with np.errstate(over="ignore"):
        if len(data) > 3:
            run = ((kind[:-3] * 16 + kind[1:-2]) * 16 + kind[2:-1]) * 16 + kind[3:]
            at = (mixed(run.astype(np.uint64)) % np.uint64(RUNS)).astype(np.int64)
            same = owner[:-3] == owner[3:]
            rows[:, :RUNS] = np.bincount((owner[:-3] * RUNS + at)[same], minlength=n * RUNS).reshape(n, RUNS)
        words, before = word_hashes(data, offsets)
        count = np.diff(before)
        if len(words):
            whose = np.repeat(np.arange(n), count)
            at = (words % np.uint64(WORDS)).astype(np.int64)
            rows[:, RUNS : RUNS + WORDS] = np.bincount(whose * WORDS + at, minlength=n * WORDS).reshape(n, WORDS)
            again = np.zeros(len(words), bool)
            again[1:] = (words[1:] == words[:-1]) & (whose[1:] == whose[:-1])
            repeats = np.bincount(whose[again], minlength=n)
            order = np.lexsort((words, whose))
            first = np.ones(len(words), bool)
            first[1:] = (words[order][1:] != words[order][:-1]) | (whose[order][1:] != whose[order][:-1])
            distinct = np.bincount(whose[order][first], minlength=n)
        else:
            repeats = distinct = np.zeros(n, np.int64)
    signs = np.bincount(owner[(kind > 6) | (kind == 3)], minlength=n)
    rows = np.where(rows > 0, 1.0 + np.log(np.maximum(rows, 1.0)), 0.0)
    size = np.sqrt((rows * rows).sum(axis=1))
    rows /= np.where(size > 0, size, 1.0)[:, None]
    shares = [repeats / np.maximum(count, 1), distinct / np.maximum(count, 1), signs / np.maximum(length, 1)]
    for k, share in enumerate(shares):
        step = np.minimum((np.sqrt(share) * STEPS).astype(np.int64), STEPS - 1)
        full = np.flatnonzero(length > 0)
        rows[full, RUNS + WORDS + k * STEPS + step[full]] = 0.5
    size = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(size > 0, size, 1.0)[:, None]


def latent_basis(rows: np.ndarray, dims: int, seed: int = 5) -> np.ndarray:
    """The first ``dims`` right singular vectors of the term matrix, by seeded subspace iteration."""
    dims = min(dims, *rows.shape)
    start = np.random.default_rng(seed).standard_normal((rows.shape[1], min(dims + 16, *rows.shape)))
    basis = np.linalg.qr(start)[0]
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :dims]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 1e-12, size, 1.0)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The share of label 1 among the k nearest, each weighing the square of its cosine with the text.

    Cosines with all labelled vectors are computed, ``block`` texts at a time.  A text without any positive cosine
    gets the share of label 1 among all labelled rows.
    """
    k = min(k, len(labelled))
    out = np.empty(len(vectors))
    for s in range(0, len(vectors), block):
        cosines = vectors[s : s + block] @ labelled.T
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0.0) ** 2
        total = weight.sum(axis=1)
        voted = (weight * labels[nearest]).sum(axis=1)
        out[s : s + block] = np.where(total > 0, voted / np.where(total > 0, total, 1.0), labels.mean())
    return np.clip(out, 0.0, 1.0)


def _rows_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for first, data, offsets in flat_texts(batch.column("text")):
            rows = term_rows(data, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(first, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "terms"])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _learner(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row of all rows (label, terms) of a task: the latent basis, the rows' unit vectors in it, and their labels."""
    def learn(batches):
        labels, terms = [], []
        for batch in batches:
            labels.append(batch.column("label").to_numpy().astype(np.float64))
            terms.append(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.float32).reshape(-1, TERMS))
        if sum(map(len, labels)):
            rows = np.concatenate(terms, dtype=np.float64)
            basis = latent_basis(rows, dims)
            found = basis, _unit(rows @ basis), np.concatenate(labels)
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()) for f in found], names=["basis", "vectors", "labels"])

    return learn


class Voter:
    """A fitted classifier: the latent basis and the labelled rows' unit vectors in it (bounded by ``sample``)."""

    def __init__(self, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.basis, self.vectors, self.labels, self.k = basis, vectors, labels, k

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(offsets) - 1, 0.5)
        return vote(_unit(term_rows(data, offsets) @ self.basis), self.vectors, self.labels, self.k)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, dims: int = 64, k: int = 7) -> Voter:
    """Learn from at most ``sample`` labelled documents that are not held out, chosen in hash order of doc_id.

    ``labels(doc_id, quality)``: rows without id or label are ignored; of several labels of a document the lowest
    counts.  The term matrix of the sample (sample x TERMS) meets in one task; the basis and the sample's vectors in it
    (dims numbers a row) are all that reaches the driver.
    """
    prepare(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    # The documents are asked first whether they are there, so that all of the sample is of use.
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = hash_sample(there, sample, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("label", "text").mapInArrow(_rows_of, "label int, terms binary").orderBy("terms", "label").limit(2 * sample)
    found = rows.coalesce(1).mapInArrow(_learner(dims), "basis binary, vectors binary, labels binary").toArrow()
    if not found.num_rows:
        return Voter(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), k)
    basis, vectors, labels = (np.frombuffer(column[0].as_buffer()) for column in found.columns)
    return Voter(basis.reshape(TERMS, -1), vectors.reshape(len(labels), -1), labels, k)


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """The documents, all columns, with ``quality_score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts have no terms and get the share of label 1 among the labelled rows (0.5 if there are none).
    Nothing but the text enters the score.  A column of that name is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("quality_score")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def scored(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, data, offsets in flat_texts(batch.column("text"))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*columns, "quality_score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
