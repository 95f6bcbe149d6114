"""Near-duplicate embeddings: cells around pivots, cover trees of their blocks, and a dual traversal of the trees' nodes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotflow.llm.common import discard, hash_sample, prepare, stored
from lotflow.llm.graph import components
from lotflow.llm.vector_cells import BLOCKS, PRODUCTS, RADII, SLACK, Block, basis, comparable_rows, net, read_blocks, rounding, to_block, to_cells, units

#: Bytes of vectors that a task holds to compare others with, that it reads beside them at once, and of the pivots.
HELD, BESIDE, PIVOTS = 1 << 26, 1 << 23, 1 << 24
#: Pairs of vectors, compared or not, that make up a task at least and that make one of its own.
LEAST_PAIRS, MOST_PAIRS = 10**7, 4 * 10**11
#: Links for each vector of two blocks from which on their trees are traversed.
DENSE = 64
#: Trees that a task keeps, and vectors with their cells that wait to be compared.
TREES, WAITING = 16, 1 << 22


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


class Tree:
    """Nested levels over the rows of ``vectors``; a node is (level, centre), its centre one of the rows.

    ``centres[l]`` are rows at most RADII[l] from every row below them, more than that apart below the same parent, and
    centres of all finer levels, too.  ``parent[l][k]`` is the place in level l - 1 of the node above, ``radius[l]``
    the largest distance from a centre to a row below it, ``owners[l]`` the node of each row.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.single = vectors, vectors.astype(np.float32)
        apart = _distances(vectors, vectors)
        n = len(vectors)
        rows = np.arange(n)
        self.centres, self.parent, self.radius = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        owner = np.zeros(n, np.int64)
        owners = [owner]
        for r in RADII[1:]:
            chosen = list(self.centres[-1])
            free = apart[self.centres[-1][owner], rows] > r
            for k in range(n):
                if free[k]:
                    chosen.append(k)
                    free &= (apart[k] > r) | (owner != owner[k])
            chosen = np.array(chosen)
            self.centres.append(chosen)
            self.parent.append(owner[chosen])
            inside = np.where(owner[chosen][:, None] == owner[None, :], apart[chosen], np.inf)
            owner = inside.argmin(axis=0)
            owners.append(owner)
        for level, own in enumerate(owners):
            radius = np.zeros(len(self.centres[level]))
            np.maximum.at(radius, own, apart[self.centres[level][own], rows])
            self.radius.append(radius)
        self.owners = owners

    def rows_of(self, level: int, node: int) -> np.ndarray:
        return np.flatnonzero(self.owners[level] == node)


def linked_pairs(a: Tree, b: Tree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal: links per row of a and of b, and links (row of a, row of b) that connect all that is linked.

    A pair of nodes farther apart than the threshold and both covering radii is dropped; one whose farthest rows are
    within the threshold links all their rows at once (counted, and connected through the centres); others go on to
    their children, at the last level to the exact cosines of their rows.  For one block with itself (``same``), both
    orders of a pair are met and a row isn't linked with itself.
    """
    most = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    count_a, count_b = np.zeros(len(a.vectors), np.int64), np.zeros(len(b.vectors), np.int64)
    ends_a, ends_b = [], []
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(RADII)):
        if level:
            p, q = _expanded(a, b, level, p, q, most)
        keep_p, keep_q = [p[:0]], [q[:0]]
        for s in range(0, len(p), 1 << 15):
            pp, qq = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
            dots = np.einsum("ij,ij->i", a.vectors[a.centres[level][pp]], b.vectors[b.centres[level][qq]])
            apart = np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))
            reach = a.radius[level][pp] + b.radius[level][qq]
            near = apart - reach <= most + SLACK
            whole = near & (apart + reach <= most - SLACK)
            for x, y in zip(pp[whole], qq[whole]):
                rows_a, rows_b = a.rows_of(level, x), b.rows_of(level, y)
                count_a[rows_a] += len(rows_b)
                count_b[rows_b] += len(rows_a)
                ends_a += [rows_a, np.full(len(rows_b), a.centres[level][x])]
                ends_b += [np.full(len(rows_a), b.centres[level][y]), rows_b]
            near &= ~whole
            keep_p.append(pp[near])
            keep_q.append(qq[near])
        p, q = np.concatenate(keep_p), np.concatenate(keep_q)
    order_a, first_a = _by_node(a.owners[-1], len(a.centres[-1]))
    order_b, first_b = _by_node(b.owners[-1], len(b.centres[-1]))
    # Rows of the last pairs, a million products at a time.
    size = np.diff(first_a)[p] * np.diff(first_b)[q]
    part = np.cumsum(size) // (1 << 20) if len(size) else size
    for k in np.unique(part):
        rows_a, rows_b = _products(p[part == k], q[part == k], (order_a, first_a), (order_b, first_b))
        hit = np.einsum("ij,ij->i", a.vectors[rows_a], b.vectors[rows_b]) >= cosine
        rows_a, rows_b = rows_a[hit], rows_b[hit]
        np.add.at(count_a, rows_a, 1)
        np.add.at(count_b, rows_b, 1)
        ends_a.append(rows_a)
        ends_b.append(rows_b)
    if same:
        # Each row has met itself once.
        count_a -= 1
    none = np.zeros(0, np.int64)
    return count_a, count_b, np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b])


def _by_node(owner: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in node order, and where each node's begin."""
    return np.argsort(owner, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=nodes))))


def _children(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    return _by_node(tree.parent[level], len(tree.centres[level - 1]))


def _products(p, q, below_a, below_b) -> tuple[np.ndarray, np.ndarray]:
    """Every member of p[i] with every member of q[i], for all i."""
    (order_a, first_a), (order_b, first_b) = below_a, below_b
    na, nb = np.diff(first_a)[p], np.diff(first_b)[q]
    total = na * nb
    which = np.repeat(np.arange(len(p)), total)
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return order_a[first_a[p][which] + place // nb[which]], order_b[first_b[q][which] + place % nb[which]]


def _expanded(a: Tree, b: Tree, level: int, p: np.ndarray, q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of the pairs of nodes p, q of the level above that are not surely too far apart.

    Where most pairs of children are asked for, one product of all centres in single precision, with room for its error,
    sorts out most of them.
    """
    below_a, below_b = _children(a, level), _children(b, level)
    total = int((np.diff(below_a[1])[p] * np.diff(below_b[1])[q]).sum())
    if total * 4 < len(a.centres[level]) * len(b.centres[level]):
        return _products(p, q, below_a, below_b)
    reach = np.add.outer((most + a.radius[level]).astype(np.float32), b.radius[level].astype(np.float32))
    dots = a.single[a.centres[level]] @ b.single[b.centres[level]].T
    near = dots >= 1.0 - 0.5 * reach * reach - 1e-4
    if total < near.size:
        alive = np.zeros((len(a.centres[level - 1]), len(b.centres[level - 1])), bool)
        alive[p, q] = True
        near &= alive[a.parent[level]][:, b.parent[level]]
    return np.nonzero(near)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links a-b connect."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


class _Met:
    """What a task has found: links that connect what is linked, and blocks that are linked as a whole."""

    def __init__(self):
        self.a, self.b, self.n, self.whole = [], [], 0, {}

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > 1 << 20:
            self.a, self.b = ([x] for x in self.spanning())
            self.n = 0

    def add_whole(self, block: Block, n: int, other: int) -> None:
        before = self.whole.get(block.name, (0, other))
        self.whole[block.name] = (before[0] + n, min(before[1], other))

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return _spanning(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))


def _sure(dots: np.ndarray, cosine: float, raw_a, x: np.ndarray, raw_b, y: np.ndarray) -> np.ndarray:
    """Which pairs are linked: by products in single precision, where these are too near by those in double precision."""
    linked = dots >= cosine
    for part in np.array_split(near := np.flatnonzero(np.abs(dots - cosine) <= rounding(raw_a.shape[1])), len(near) // (1 << 15) + 1):
        linked[part] = np.einsum("ij,ij->i", units(raw_a[x[part]]), units(raw_b[y[part]])) >= cosine
    return linked


def _near(dots: np.ndarray, cosine: float, dim: int) -> np.ndarray:
    return dots >= np.float32(cosine - rounding(dim))


def _within_cell(a: Block, b: Block, cosine: float, met: _Met, trees: dict[str, Tree]) -> None:
    """Links of two blocks of one cell, or of a block with itself.

    Blocks whose farthest vectors are near enough are linked as wholes.  Others are compared by one product; where that
    shows many links, their trees are traversed instead of listing them all.
    """
    same, most = a.name == b.name, math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    apart, reach = 0.0 if same else math.sqrt(max(0.0, 2.0 - 2.0 * float(a.centre @ b.centre))), a.radius + b.radius
    if apart - reach > most + SLACK or same and len(a.ids) == 1:
        return
    if apart + reach <= most - SLACK:
        met.add_whole(a, len(b.ids) - same, b.low)
        if not same:
            met.add_whole(b, len(a.ids), a.low)
            met.add(np.array([a.low]), np.array([b.low]))
        return
    dots = a.single @ b.single.T
    near = _near(dots, cosine, a.dim)
    if same:
        near = np.triu(near, 1)
    if np.count_nonzero(near) > DENSE * (len(a.ids) + len(b.ids)):
        count_a, count_b, x, y = linked_pairs(_tree(a, trees), _tree(b, trees), cosine, same)
        a.links += count_a
        if not same:
            b.links += count_b
    else:
        x, y = np.divmod(at := np.flatnonzero(near.ravel()), len(b.ids))
        linked = _sure(dots.ravel()[at], cosine, a.raw, x, b.raw, y)
        x, y = x[linked], y[linked]
        np.add.at(a.links, x, 1)
        np.add.at(b.links, y, 1)
    met.add(a.ids[x], b.ids[y])


def _tree(block: Block, trees: dict[str, Tree]) -> Tree:
    if block.name not in trees:
        if len(trees) == TREES:
            trees.pop(next(iter(trees)))
        trees[block.name] = Tree(units(block.raw))
    return trees[block.name]


def _margins(raw: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How much larger each vector's product with its own pivot is than that with the other; a row's result depends on that row alone."""
    parts = [slice(s, s + (1 << 15)) for s in range(0, len(raw), 1 << 15)]
    return np.concatenate([np.zeros(0), *[(units(raw[p]) * (own[p].astype(np.float64) - other[p])).sum(axis=1) for p in parts]])


class _Beside:
    """Blocks of one vector length that a task compares with the cells that it holds.

    Of two linked vectors x and y below pivots p and q, (x - y)(p - q) is at most the threshold times |p - q|, and it is the sum of
    two margins: how much nearer x is to p than to q, and y to q than to p.  So the one with the smaller margin, by which the
    link is counted, has at most half of that, and only such vectors are compared with the other's cell.
    """

    def __init__(self, blocks: list[Block], held: dict[int, list[Block]], cells: np.ndarray, pivots: np.ndarray, start: int, cosine: float, met: _Met):
        self.blocks, self.held, self.cells, self.pivots, self.start, self.cosine, self.met = blocks, held, cells, pivots, start, cosine, met
        self.most = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
        sizes = [len(a.ids) for a in blocks]
        self.first = np.cumsum([0, *sizes])
        self.cell = np.repeat([a.cell for a in blocks], sizes)
        self.single, self.raw, self.ids = (np.concatenate([getattr(a, c) for a in blocks]) for c in ("single", "raw", "ids"))
        self.outline = self.single if blocks[0].outline is blocks[0].single else np.concatenate([a.outline for a in blocks])
        self.links = np.zeros(len(self.ids), np.int64)

    def compare(self) -> None:
        centres, room, found, n = self.pivots[self.cells - self.start], rounding(self.pivots.shape[1]), [], 0
        # One product gives how far a vector's margin is below what the cell admits: entries, one, and its own pivot's product; entries, bound, and minus one.
        there = np.concatenate((centres, np.zeros((len(centres), 1), np.float32), np.full((len(centres), 1), -1.0, np.float32)), axis=1)
        step = max(1, PRODUCTS // len(centres))
        for first, a in zip(self.first, self.blocks):
            own = self.pivots[a.cell - self.start]
            half = 0.5 * self.most * np.sqrt(np.maximum(2.0 + 2.0 * room - 2.0 * (centres @ own), 0.0)) + 4.0 * room + SLACK
            # Not its own cell: no product of unit vectors makes up for this.
            there[:, -2] = np.where(self.cells == a.cell, -8.0, half)
            for s in range(0, len(a.ids), step):
                rows = a.single[s : s + step]
                mine = rows @ own
                below = np.concatenate((rows, np.ones((len(rows), 1), np.float32), mine[:, None]), axis=1) @ there.T
                at = np.flatnonzero((below >= 0.0).ravel())
                row, cell = np.divmod(at, len(centres))
                found.append((row + first + s, cell, below.ravel()[at] - there[cell, -2] + mine[row]))
                n += len(at)
                if n > WAITING:
                    self._meet(found)
                    found, n = [], 0
        if n:
            self._meet(found)
        for first, a in zip(self.first, self.blocks):
            a.links += self.links[first : first + len(a.ids)]

    def _meet(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Compare the rows found with the blocks of the cells they were found for."""
        row, cell, dots = (np.concatenate(x) for x in zip(*found))
        # Short numbers are sorted by their digits.
        order = np.argsort(cell.astype(np.uint16) if len(self.cells) < 1 << 16 else cell, kind="stable")
        row, cell, apart = row[order], cell[order], np.sqrt(np.maximum(2.0 - 2.0 * dots[order], 0.0))
        reach = self.most + math.sqrt(2.0 * rounding(self.pivots.shape[1])) + SLACK
        ends = np.flatnonzero(np.diff(cell, append=-1)) + 1
        for s, e in zip(np.concatenate(([0], ends[:-1])), ends):
            for b in self.held[int(self.cells[cell[s]])]:
                rows = row[s:e][(apart[s:e] - reach <= b.farthest) & (apart[s:e] + reach >= b.nearest)]
                step = max(1, PRODUCTS // len(b.ids))
                for k in range(0, len(rows), step):
                    self._link(rows[k : k + step], b)

    def _link(self, rows: np.ndarray, b: Block) -> None:
        dots, least = self.outline[rows] @ b.outline.T, self.cosine - 2.0 * rounding(b.dim)
        # Mostly none is near.
        if dots.max() < least:
            return
        x, y = np.divmod(np.flatnonzero((dots >= np.float32(least)).ravel()), len(b.ids))
        if self.outline is not self.single:
            dots = (self.single[rows] @ b.single.T)[x, y] if len(x) > dots.size // 32 else np.einsum("ij,ij->i", self.single[rows[x]], b.single[y])
        else:
            dots = dots[x, y]
        x, near = rows[x], _near(dots, self.cosine, b.dim)
        x, y = x[near], y[near]
        linked = _sure(dots[near], self.cosine, self.raw, x, b.raw, y)
        x, y = x[linked], y[linked]
        if not len(x):
            return
        # The other vector's cell meets this one's, too: a link is counted by the vector with the smaller margin.
        there = self.pivots[b.cell - self.start]
        some, back = np.unique(x, return_inverse=True)
        margin = _margins(self.raw[some], self.pivots[self.cell[some] - self.start], np.broadcast_to(there, (len(some), len(there))))[back]
        pairs, back = np.unique(np.stack((y, self.cell[x])), axis=1, return_inverse=True)
        other = _margins(b.raw[pairs[0]], np.broadcast_to(there, (pairs.shape[1], len(there))), self.pivots[pairs[1] - self.start])[back.ravel()]
        mine = (margin < other) | (margin == other) & (self.cell[x] < b.cell)
        x, y = x[mine], y[mine]
        np.add.at(self.links, x, 1)
        np.add.at(b.links, y, 1)
        self.met.add(self.ids[x], b.ids[y])


def _gathered(blocks: Iterator[Block]) -> Iterator[list[Block]]:
    some, size = [], 0
    for block in blocks:
        some.append(block)
        size += block.raw.nbytes
        if size >= BESIDE:
            yield some
            some, size = [], 0
    if some:
        yield some


_MET = "vec_id long, block string, n long, other long"


def _rows(ids: np.ndarray, n: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.string()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["vec_id", "block", "n", "other"])


def _compare(folder: str, tasks: list[tuple[list[str], list[str]]], kind: str, nets: dict[int, np.ndarray], starts: dict[int, int],
             bases: dict[int, np.ndarray | None], cosine: float):
    """Links of the vectors in the files that a task holds with those in the files that it reads beside them, one batch after the other."""
    def task(system, top: str, files: list[str], beside: list[str]) -> Iterator[pa.RecordBatch]:
        read = lambda names: (b for f in names for b in read_blocks(system, f"{top}/{f}", kind, bases))
        held, met, trees = {}, _Met(), {}
        for b in read(files):
            held.setdefault(b.cell, []).append(b)
        cells = {d: np.array(sorted(c for c, bs in held.items() if bs[0].dim == d and c >= 0)) for d in nets}
        for some in _gathered(read(beside)):
            for a in some:
                for b in held.get(a.cell, ()):
                    if a.name <= b.name:
                        _within_cell(a, b, cosine, met, trees)
            for d, pivots in nets.items():
                if len(cells[d]) and (blocks := [a for a in some if a.dim == d and a.cell >= 0]):
                    _Beside(blocks, held, cells[d], pivots, starts[d], cosine, met).compare()
            yield from counted(some)
            # The next ones are read before this list is let go.
            some.clear()
            a = blocks = None
        yield from counted([b for bs in held.values() for b in bs])
        nodes, roots = met.spanning()
        yield _rows(nodes, np.zeros(len(nodes), np.int64), roots)
        whole = [(None, name, n, other) for name, (n, other) in met.whole.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*whole), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["vec_id", "block", "n", "other"]) if whole else _rows(nodes[:0], nodes[:0], nodes[:0])

    def counted(blocks: list[Block]) -> Iterator[pa.RecordBatch]:
        ids, links = np.concatenate([np.zeros(0, np.int64), *[b.ids for b in blocks]]), np.concatenate([np.zeros(0, np.int64), *[b.links for b in blocks]])
        hit = links > 0
        if hit.any():
            yield _rows(ids[hit], links[hit], ids[hit])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        for k in (k for batch in batches for k in batch.column("id").to_pylist() if k < len(tasks)):
            yield from task(system, top, *tasks[k])

    return compare


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What holds for a block, for each of its vectors."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["n"])), pa.array(np.full(len(ids), row["other"]))], ["vec_id", "n", "other"])


def _in_parts(files: list[tuple[str, int]], most: float) -> list[list[str]]:
    """Files in their order, in parts of about ``most`` bytes."""
    parts, size = [], most
    for name, more in files:
        if size >= most:
            parts.append([])
            size = 0
        parts[-1].append(name)
        size += more
    return parts


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = 2048, pivots: int = 1 << 16,
                           sample: int = 1 << 17, cell: int = 256) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id, kept.

    Two vectors are linked if their cosine in double precision is at least ``cosine``.  Null, empty or zero vectors,
    and those with a null or non-finite entry, are linked with nothing; so are vectors of different lengths.

    The top of the tree are at most ``pivots`` vectors, one for each ``cell`` vectors of a small table and fewer in a large one,
    of at most ``sample`` vectors in hash order, none nearer than the threshold to another; every vector goes below
    its nearest pivot, in a cell of more than ``block`` vectors into the finest of the nested balls around it that holds it, and a
    ball's vectors are cut into blocks of about ``block``.  Within a cell, blocks too far apart for their covering radii are not compared, blocks near enough are
    linked as a whole, and the others are compared or meet in a dual traversal of their cover trees (radii halve from level to
    level).  Across cells, a vector is compared with the cells that its margin between the pivots admits (``_Beside``).
    The result is exact whatever the pivots are.  How much is compared depends on the data: of directions spread evenly over many
    dimensions a vector meets a small share of the cells only, but its products with all pivots are looked at.

    Vectors move once, into their blocks, with entries as given.  The blocks are stored, and tasks read what they compare from
    there, so the shared folder must be one that pyarrow knows (mounted, HDFS, S3, GCS).

    Rows that share a vec_id are one vector if their entries agree, else each links for the id.  Without a vec_id, a
    row is compared with none.  No rows give no rows; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, entries = ("<f4", "float") if single else ("<f8", "double")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{entries}>").alias("embedding"))
    known = source.filter("vec_id is not null and embedding is not null")
    n, dim = known.agg(F.count(F.lit(1)), F.greatest(F.lit(1.0), F.avg(F.size("embedding")))).first()
    width = (dim or 1.0) * (4 if single else 8)
    wanted = max(1, min(pivots, n // cell, int(0.8 * n**0.6), int(PIVOTS / (4 * (dim or 1.0)))))
    block = min(block, max(256, n // 64), max(16, int((1 << 20) / width)))
    found: dict[int, list[np.ndarray]] = {}
    chosen = hash_sample(known, min(sample, 2 * wanted) if wanted > 1 else 1, "vec_id").select("embedding").toArrow()
    for _, raw in comparable_rows(chosen.column(0).combine_chunks()):
        found[raw.shape[1]] = units(raw)
    most = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    nets = {d: net(us, max(1, wanted * len(us) // sum(map(len, found.values()))), most) for d, us in found.items()}
    starts, total = {}, 0
    for d in nets:
        starts[d], total = total, total + len(nets[d])

    cells = stored(known.mapInArrow(to_cells(nets, starts), "vec_id long, raw binary, dim int, cell int, ring int, apart double"), "cells")
    # At most one row per pivot, level and vector length.  A cell that is no larger than a block is one.
    nodes = ["cell", "ring", "dim"]
    counts = stored(cells.groupBy(*nodes).agg(F.count(F.lit(1)).alias("rows")), "cell-counts")
    large = F.col("all") > block
    sizes = counts.join(counts.groupBy("cell", "dim").agg(F.sum("rows").alias("all")), ["cell", "dim"]).select(
        *nodes, F.when(large, F.col("ring")).otherwise(-1).alias("ball"), F.when(large, F.ceil(F.col("rows") / block)).otherwise(1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "raw", F.lit(7)), F.col("parts")).cast("int").alias("part")
    placed = cells.join(sizes, nodes).select("vec_id", "raw", "apart", "cell", F.col("ball").alias("ring"), part, "dim")
    a_file = max(1, min(64, (sizes.select("cell", "ball", "dim", "parts").distinct().agg(F.sum("parts")).first()[0] or 0) // 64))
    blocks = stored(placed.groupBy("cell", "ring", "part", "dim").applyInArrow(to_block(kind), BLOCKS), "blocks", "none", maxRecordsPerFile=a_file)
    discard(cells, counts)

    # Each task holds some files and compares them with others that it reads.
    files = blocks.select("_metadata.file_name", (F.col("n") * F.col("dim") * (4 if single else 8)).alias("size")).groupBy("file_name").agg(F.sum("size"))
    files = sorted(map(tuple, files.collect()))
    held = _in_parts(files, HELD)
    wanted = max(min(4 * spark.sparkContext.defaultParallelism, n * n // LEAST_PAIRS), n * n // MOST_PAIRS, 1)
    beside = _in_parts(files, sum(size for _, size in files) * max(1, len(held)) / wanted)
    tasks = [(h, b) for b in beside for h in held]
    compared = spark.range(0, max(1, len(tasks)), 1, max(1, len(tasks))).mapInArrow(
        _compare(blocks.stored_at, tasks, kind, nets, starts, {d: basis(p) for d, p in nets.items()}, cosine), _MET)
    met = stored(compared, "met")
    whole = met.filter("block is not null").groupBy("block").agg(F.sum("n").alias("n"), F.min("other").alias("other"))
    members = blocks.select("block", "ids").join(whole, "block").mapInArrow(_members, "vec_id long, n long, other long")
    links = stored(met.filter("vec_id is not null").select("vec_id", "n", "other").unionAll(members), "links")
    named = components(links.filter("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy(F.col("vec_id").alias("node")).agg(F.sum("n").alias("n_links"))
    found_rows = stored(counts.join(named, "node", "full").withColumnRenamed("node", "vec_id"), "vector-links")
    discard(blocks, met, links, named)
    out = source.select("vec_id").join(found_rows, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
