"""Vectors in cells around pivots, and their blocks: what a cover tree of all vectors has above the trees of its blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

#: Radii of the nested levels of a tree, each half of the one above; unit vectors are at most 2 apart.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
#: Distances are trusted to this much when a bound excludes or includes something.
SLACK = 1e-7
#: Products of single precision that are worked on at once: what a core's cache holds.
PRODUCTS = 1 << 18
#: Directions of a vector's outline, and vectors that are worth one.
OUTLINE, OUTLINED = 23, 48


def rounding(dim: int) -> float:
    """More than single precision can be off in a product of two unit vectors that are made in it."""
    return (dim + 8) * 2.0**-22


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; a row's result depends on that row alone."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def comparable_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: places of the rows that can be compared, and their entries as given (a negative zero is zero)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    starts, entries = vectors.offsets.to_numpy()[:-1], vectors.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == dim)
        # A null entry is not a number here.
        raw = entries[starts[places][:, None] + np.arange(dim)] + entries.dtype.type(0)
        size = np.abs(raw).max(axis=1)
        good = np.isfinite(size) & (size > 0)
        if good.any():
            yield places[good], raw[good]


def net(rows: np.ndarray, most: int, apart: float) -> np.ndarray:
    """At most ``most`` of the unit rows, in their order, in single precision; none nearer than ``apart`` to one before it."""
    rows, limit = rows.astype(np.float32), 1.0 - 0.5 * apart * apart
    chosen = rows[:0]
    for s in range(0, len(rows), 512):
        some = rows[s : s + 512]
        if len(chosen):
            some = some[(some @ chosen.T).max(axis=1) < limit]
        near, free = some @ some.T >= limit, np.ones(len(some), bool)
        for k in range(len(some)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        chosen = np.concatenate((chosen, some[free]))
        if len(chosen) >= most:
            break
    return chosen[:most]


def singles(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    x = raw.astype(np.float32) if np.abs(raw).max() < 1e15 else np.full((1, 1), np.inf, np.float32)
    size = np.einsum("ij,ij->i", x, x)
    if 1e-30 < size.min() <= size.max() < 1e30:
        return x * (np.float32(1) / np.sqrt(size))[:, None]
    return units(raw).astype(np.float32)


def basis(rows: np.ndarray) -> np.ndarray | None:
    """The directions in which the unit rows differ most, side by side; none where a product of vectors is short anyway."""
    if rows.shape[1] < OUTLINED:
        return None
    rows = rows.astype(np.float64)
    return np.linalg.eigh(rows.T @ rows)[1][:, -OUTLINE:].astype(np.float32)


def outlines(single: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The vectors in these directions, and the length of what is left: the product of two outlines is at least that of the vectors."""
    inside = single @ directions
    left = np.maximum(1.0 - np.einsum("ij,ij->i", inside, inside), 0.0) + np.float32(rounding(single.shape[1]))
    return np.concatenate((inside, np.sqrt(left, dtype=np.float32)[:, None]), axis=1)


def nearest(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot and the product with it in double precision, whatever rows it is asked with."""
    single, room, found = unit.astype(np.float32), np.float32(2 * rounding(unit.shape[1])), []
    best = np.full(len(unit), -np.inf, np.float32)
    for s in range(0, len(unit), 256):
        some, most = single[s : s + 256], best[s : s + 256]
        for first in range(0, len(pivots), PRODUCTS // 256):
            dots = pivots[first : first + PRODUCTS // 256] @ some.T
            np.maximum(most, dots.max(axis=0), out=most)
            pivot, row = np.divmod(at := np.flatnonzero((dots >= most - room).ravel()), len(some))
            found.append((row + s, pivot + first, dots.ravel()[at]))
    row, pivot, dots = (np.concatenate(x) for x in zip(*found))
    near = dots >= best[row] - room
    row, pivot = row[near], pivot[near]
    exact = (unit[row] * pivots[pivot]).sum(axis=1)
    order = np.lexsort((pivot, -exact, row))
    first = order[np.concatenate(([True], np.diff(row[order]) > 0))]
    return pivot[first], exact[first]


def _binary(raw: np.ndarray) -> pa.Array:
    """One value of bytes a row."""
    width = raw.shape[1] * raw.itemsize
    ends = pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, ends, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def to_cells(nets: dict[int, np.ndarray], starts: dict[int, int]):
    """(vec_id, raw, dim, cell, ring, apart): the entries as bytes, the nearest pivot of the same length, the finest level that
    covers, and the distance.  A row that its batch has before is left out."""
    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for places, raw in comparable_rows(batch.column("embedding")):
                dim, n = raw.shape[1], len(raw)
                pivot, dots = nearest(units(raw), nets[dim]) if dim in nets else (np.zeros(n, np.int64), np.zeros(n))
                apart = np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))
                ring = (apart[:, None] <= np.array(RADII) + SLACK).sum(axis=1) - 1
                rows = pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(places)), _binary(raw), pa.array(np.full(n, dim, np.int32)),
                     pa.array((starts.get(dim, -dim) + pivot).astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(apart)],
                    names=["vec_id", "raw", "dim", "cell", "ring", "apart"])
                yield from pa.Table.from_batches([rows]).group_by(rows.schema.names).aggregate([]).to_batches() if pc.count_distinct(rows.column("vec_id")).as_py() < n else [rows]

    return assign


BLOCKS = ("block string, cell int, dim int, n long, low long, centre array<double>, radius double, nearest double, farthest double, "
          "ids binary, raw binary")


def to_block(kind: str):
    """One block of a cell's vectors: ids, entries, a centre and its covering radius, and the distances to the cell's pivot."""
    def pack(key, rows):
        cell, ring, part, dim = (k.as_py() for k in key)
        if pc.count_distinct(rows["vec_id"]).as_py() < len(rows):
            rows = rows.group_by(["vec_id", "raw", "apart"]).aggregate([])
        ids, apart = rows["vec_id"].to_numpy(), rows["apart"].to_numpy()
        raw = b"".join(rows["raw"].to_pylist())
        unit = units(np.frombuffer(raw, kind).reshape(-1, dim))
        centre = unit.mean(axis=0)
        norm = np.sqrt(centre @ centre)
        centre = centre / norm if norm > 0 else unit[0]
        radius = np.sqrt(np.maximum(2.0 - 2.0 * (unit @ centre), 0.0)).max()
        return pa.table({
            "block": [f"{cell}-{ring}-{part}"], "cell": pa.array([cell], pa.int32()), "dim": pa.array([dim], pa.int32()), "n": [len(ids)], "low": [int(ids.min())],
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [float(radius)], "nearest": [float(apart.min())], "farthest": [float(apart.max())],
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "raw": pa.array([raw], pa.binary())})

    return pack


class Block:
    """A stored block as a task holds it."""

    def __init__(self, row: dict, kind: str, bases: dict[int, np.ndarray | None]):
        self.name, self.cell, self.dim, self.low, self.radius = row["block"], row["cell"], row["dim"], row["low"], row["radius"]
        self.nearest, self.farthest, self.centre = row["nearest"], row["farthest"], np.array(row["centre"])
        self.ids, self.raw = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["raw"], kind).reshape(-1, row["dim"])
        self.single, self.links = singles(self.raw), np.zeros(len(self.ids), np.int64)
        directions = bases.get(self.dim)
        self.outline = self.single if directions is None else outlines(self.single, directions)


def read_blocks(system, path: str, kind: str, bases: dict[int, np.ndarray | None]) -> Iterator[Block]:
    """The blocks of one file."""
    with system.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(16):
            for row, raw in zip(batch.drop_columns(["raw"]).to_pylist(), batch.column("raw")):
                yield Block(row | {"raw": raw.as_buffer()}, kind, bases)
