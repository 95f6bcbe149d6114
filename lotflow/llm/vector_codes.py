"""Product codes of vectors: codebooks by rounds of integer means, nearest entries by slices and intersected bit masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import prepare, stored

#: Entries of a codebook: one bit each of an unsigned 64-bit mask.
MOST_ENTRIES = 64
#: Components of a larger size can't be summed exactly in 64 bits; their vectors have no code.
MOST = 1 << 26


class Slices:
    """One part's codebook, sorted along every dimension; ``masks[t][k]`` has the bits of the k smallest along t."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.orders, self.sorted, self.masks = [], [], []
        for column in entries.T:
            order = np.argsort(column, kind="stable")
            bits = np.uint64(1) << order.astype(np.uint64)
            self.orders.append(order)
            self.sorted.append(column[order])
            self.masks.append(np.concatenate((np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits))))

    def _first_radius(self, points: np.ndarray) -> np.ndarray:
        """A bound for the distance to the nearest entry: that of the best among those next to the point along a dimension."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        for t, (line, order) in enumerate(zip(self.sorted, self.orders)):
            at = np.searchsorted(line, points[:, t])
            for k in (at - 1, at):
                chosen = self.entries[order[np.clip(k, 0, len(line) - 1)]]
                best = np.minimum(best, ((points - chosen) ** 2).sum(axis=1))
        # One more than the root: rounding must not shut out the entry that gave the bound.
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equal ones) and the squared distance, exactly.

        Entries within the radius lie, along every dimension, in the slice between the point less and plus the radius.
        A slice's entries are the difference of two masks; what is in all slices is left as candidates, whose distances are
        computed bit by bit.
        """
        radius = self._first_radius(points)
        left = np.full(len(points), ~np.uint64(0))
        for t, line in enumerate(self.sorted):
            low = np.searchsorted(line, points[:, t] - radius, "left")
            high = np.searchsorted(line, points[:, t] + radius, "right")
            left &= self.masks[t][high] & ~self.masks[t][low]
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows):
            lowest = left & (~left + np.uint64(1))
            entry = np.frexp(lowest.astype(np.float64))[1] - 1
            distance = ((points[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = distance < best[rows]
            best[rows[better]], index[rows[better]] = distance[better], entry[better]
            left = left ^ lowest
            rows, left = rows[left != 0], left[left != 0]
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``: integers."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points (n, dimension): entry and squared distance of each part, as (n, parts)."""
        parts, _, width = self.entries.shape
        found = [Slices(self.entries[p]).nearest(points[:, p * width : (p + 1) * width]) for p in range(parts)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _points(column: pa.Array, scale: float, dimension: int | None, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that have a code, and their integer components."""
    column = column.cast(pa.list_(pa.float64()))
    offsets, flat = column.offsets.to_numpy(), column.values
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat.to_numpy(zero_copy_only=False)))))
    lengths = np.diff(offsets)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0) & (lengths % parts == 0)
    if dimension:
        good &= lengths == dimension
    values = flat.to_numpy(zero_copy_only=False)
    rows, points = [], []
    for k in np.flatnonzero(good).tolist():
        with np.errstate(over="ignore"):
            scaled = np.floor(values[offsets[k] : offsets[k + 1]] * scale)
        if (np.abs(scaled) < MOST).all():
            rows.append(k)
            points.append(scaled.astype("<i4"))
    return np.array(rows, np.int64), points


def integer_vectors(vectors: DataFrame, scale: float = 256.0, parts: int = 16, vector: str = "embedding") -> DataFrame:
    """All columns but ``vector``, and ``point``: its components times ``scale``, rounded down, as 32-bit integers.

    A row is left out if its vector is null, empty, of a length that ``parts`` doesn't divide, or has a null or non-finite
    component or one of ``MOST`` or more after scaling.
    """
    others = [c for c in vectors.columns if c != vector]
    keep = vectors.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, points = _points(batch.column("vector"), scale, None, parts)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), pa.array([p.tobytes() for p in points], pa.binary())], ["row", "point"])

    done = keep.mapInArrow(convert, f"row {keep.schema['row'].dataType.simpleString()}, point binary")
    return done.select("row.*", "point")


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimension).astype(np.int64)


def _first_codebooks(points: DataFrame, parts: int, entries: int, name: str) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; of other lengths than the first one's, none."""
    rows = points.select(F.col(f"`{name}`").alias("id"), "point")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "point").limit(1).collect()
    if not first:
        return None
    size = len(first[0]["point"])
    # At most 64 vectors.
    few = rows.filter(F.octet_length("point") == size).orderBy(F.col("id").asc_nulls_last(), "point").limit(entries).collect()
    found = np.stack([np.frombuffer(r["point"], "<i4") for r in few]).astype(np.int64)
    return Codebooks(np.ascontiguousarray(found.reshape(len(few), parts, -1).transpose(1, 0, 2)))


def _sums(books: Codebooks):
    """Per task: how many points each entry is nearest to, and the sums of their components."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            points = _matrix(batch.column("point"), books.dimension)
            if not len(points):
                continue
            nearest, _ = books.nearest(points)
            for p in range(parts):
                count[p] += np.bincount(nearest[:, p], minlength=entries)
                np.add.at(total[p], nearest[:, p], points[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "n", *[f"s{t}" for t in range(width)]])

    return add


def _next_codebooks(points: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean, rounded down, of the parts nearest to it; an entry without any stays.

    A task sends one row for each entry in use, however many vectors it reads, and the driver gets one row an entry.
    """
    width = books.entries.shape[2]
    names = ["n", *[f"s{t}" for t in range(width)]]
    sums = points.select("point").mapInArrow(_sums(books), "part long, entry long, " + ", ".join(f"{c} long" for c in names))
    entries = books.entries.copy()
    for row in sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect():
        entries[row["part"], row["entry"]] = [row[f"s{t}"] // row["n"] for t in range(width)]
    return Codebooks(entries)


def fit(points: DataFrame, parts: int = 16, entries: int = MOST_ENTRIES, rounds: int = 2, name: str = "vec_id") -> Codebooks | None:
    """Codebooks of ``points`` as ``integer_vectors`` gives them (store them first: every round reads them); None of no rows.

    They start as the parts of the vectors with the ``entries`` smallest values of ``name`` (nulls last, equal ones by their
    components).  Vectors of another length than the first one's count for nothing.
    """
    if not 1 <= entries <= MOST_ENTRIES:
        raise ValueError(f"a codebook has 1 to {MOST_ENTRIES} entries")
    books = _first_codebooks(points, parts, entries, name)
    if books is None:
        return None
    same = points.filter(F.octet_length("point") == 4 * books.dimension)
    for _ in range(rounds):
        books = _next_codebooks(same, books)
    return books


def encode(points: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of ``points`` but ``point``, with ``code`` (binary: one byte a part, the entry's index) and ``error`` (long: the
    squared distances, summed over the parts).  Vectors of another length than the codebooks' are left out."""
    others = [c for c in points.columns if c != "point"]
    rows = points.filter(F.octet_length("point") == 4 * books.dimension).select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "point")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance = books.nearest(_matrix(batch.column("point"), books.dimension))
            codes = [c.tobytes() for c in nearest.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.binary()), pa.array(distance.sum(axis=1))], ["row", "code", "error"])

    done = rows.mapInArrow(code, f"row {rows.schema['row'].dataType.simpleString()}, code binary, error long")
    return done.select("row.*", "code", "error")


def decode(codes: DataFrame, books: Codebooks, scale: float = 256.0) -> DataFrame:
    """The columns of ``codes`` but ``code``, with ``vector``: the entries that a code names, over ``scale``."""
    others = [c for c in codes.columns if c != "code"]
    rows = codes.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "code")
    parts = books.entries.shape[0]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            found = books.entries[np.arange(parts), code].reshape(len(code), books.dimension) / scale
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(found), pa.list_(pa.float64()))], ["row", "vector"])

    done = rows.mapInArrow(back, f"row {rows.schema['row'].dataType.simpleString()}, vector array<double>")
    return done.select("row.*", "vector")


def compress(vectors: DataFrame, parts: int = 16, entries: int = MOST_ENTRIES, rounds: int = 2, scale: float = 256.0,
             name: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """(codes, codebooks): ``encode`` of all ``vectors`` with codebooks learned from all of them.

    Every vector is read, none is sampled; the rounds read a stored table of integers.  Rows that ``integer_vectors`` leaves
    out, and vectors of another length than that of the smallest id, have no code.  Repeated rows count as often as they
    are there, null ids come last, and other columns pass through, but for input columns named as those added, which give
    way to them.  No rows give no rows and None.
    """
    spark = prepare(vectors.sparkSession)
    vectors = vectors.drop("point", "code", "error")
    points = stored(integer_vectors(vectors, scale, parts, vector), "integer-vectors")
    books = fit(points, parts, entries, rounds, name)
    if books is None:
        return spark.createDataFrame([], points.drop("point").withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")}).schema), None
    return encode(points, books), books
