"""Boosted trees by second-order steps: a level of a tree is one aggregate of gradients and hessians over (node, input, bin)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.session import shared_dir

#: Rounds after which margins are made from these, no more from those before; rows of a block, but for the last batch of a task.
CUT_EVERY, BLOCK_ROWS = 10, 65_536
# The largest step of a count model on its log scale, the least gain of a split, the first prediction.
MAX_STEP, LEAST_GAIN, START = 0.7, 1e-6, 0.5
#: Splits whose gains differ by less than this share count as equal: the first one, by input and bin, is taken.
SAME = 1e-9
STATE = "bins binary, y binary, parts binary"
SETTINGS = "inputs array<string>, prediction string, objective string, base double, depth int, trees string"


@dataclass(frozen=True)
class Objective:
    """Gradients and hessians of rows by their margins and labels, the prediction of a margin, the first margin, and the bound of a
    leaf's step (0: none)."""

    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    of_margin: Callable[[Column], Column]
    start: float
    most: float = 0.0


OBJECTIVES = {
    "squared": Objective(lambda m, y: (m - y, np.ones(len(y))), lambda m: m, START),
    # The hessian is taken a step further along the exponential, which keeps early steps short.
    "poisson": Objective(lambda m, y: (np.exp(m) - y, np.exp(m + MAX_STEP)), F.exp, math.log(START), MAX_STEP),
}


@dataclass
class Tree:
    """Nodes as a heap: the children of n are 2n + 1 (smaller values and nulls) and 2n + 2.  ``feature`` is -1 at a leaf."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    value: list[float]
    gain: list[float]

    @staticmethod
    def root(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree([-1] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def prune(self, gamma: float) -> None:
        """Take splits back, from the bottom, that end in two leaves and gain less than ``gamma``."""
        for n in range(len(self.feature) // 2 - 1, -1, -1):
            if self.feature[n] >= 0 and self.feature[2 * n + 1] < 0 and self.feature[2 * n + 2] < 0 and self.gain[n] < gamma:
                self.feature[n] = -1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends, given a line of ``bins`` per input."""
        feature, rows = np.array(self.feature), np.arange(bins.shape[1])
        inner, nodes = feature >= 0, np.arange(len(feature))
        below = np.where(inner, [2 * nodes + 1, 2 * nodes + 2], nodes).T.reshape(-1)
        place, last, flat = np.where(inner, feature, 0) * bins.shape[1], np.array(self.bin), bins.reshape(-1)
        node = np.zeros(bins.shape[1], np.int64)
        while inner[node].any():
            node = below[2 * node + (flat[place[node] + rows] > last[node])]
        return node


def _leaf(tree: Column, depth: int, goes_left) -> Column:
    """The node in which a row ends."""
    def down(node: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], node)
        return F.when(feature < 0, node).when(goes_left(feature, node), 2 * node + 1).otherwise(2 * node + 2)

    return F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(0), down)


def _constant(trees: list[Tree], *fields: str) -> Column:
    """Trees as one constant array: the optimizer reads the text once, and generated code stays the same."""
    kinds = {"feature": "array<int>", "cut": "array<double>", "value": "array<double>"}
    text = json.dumps([{f: getattr(t, f) for f in fields} for t in trees])
    return F.from_json(F.lit(text), f"array<struct<{', '.join(f'{f}: {kinds[f]}' for f in fields)}>>")


@dataclass
class BoostedTrees:
    inputs: list[str]
    prediction: str
    objective: str
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction: one expression over the arrays of all trees."""
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.inputs])

        def add(total: Column, tree: Column) -> Column:
            # A null is smaller than any cut.
            left = lambda feature, node: F.coalesce(F.get(values, feature) < F.get(tree["cut"], node), F.lit(True))
            return total + F.get(tree["value"], _leaf(tree, self.depth, left))

        margin = F.aggregate(_constant(self.trees, "feature", "cut", "value"), F.lit(self.base), add) if self.trees else F.lit(self.base)
        return rows.withColumn(self.prediction, OBJECTIVES[self.objective].of_margin(margin))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row below ``path``."""
        row = [(self.inputs, self.prediction, self.objective, self.base, self.depth, json.dumps([vars(t) for t in self.trees]))]
        spark.createDataFrame(row, SETTINGS).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        row = spark.read.schema(SETTINGS).parquet(path).first()
        trees = [Tree(**t) for t in json.loads(row["trees"])]
        return BoostedTrees(list(row["inputs"]), row["prediction"], row["objective"], row["base"], row["depth"], trees)


def cut_points(rows: DataFrame, inputs: list[str], bins: int) -> list[list[float]]:
    """Where an input may be split, in order: at every value but the least if there are few, else at quantiles and the largest."""
    value = {c: F.col(f"`{c}`").cast("double") for c in inputs}
    known = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    counts = rows.agg(*[F.approx_count_distinct(known[c], 0.02).alias(f"n{k}") for k, c in enumerate(inputs)]).first()
    # An estimate of half the bins can't stand for more values than twice the bins.
    few = [2 * (counts[f"n{k}"] or 0) <= bins for k in range(len(inputs))]
    shares = [k / (bins - 1) for k in range(bins)]
    found = rows.agg(*[
        (F.array_sort(F.collect_set(known[c])) if few[k] else F.array_append(F.percentile_approx(known[c], shares, 20 * bins), F.max(known[c]))).alias(f"c{k}")
        for k, c in enumerate(inputs)]).first()
    return [sorted(set(x for x in found[f"c{k}"] or [] if x is not None))[1:] for k in range(len(inputs))]


@dataclass
class Block:
    """Rows of a task as arrays: each distinct row of bins once, one line of bytes per input, with its margin; for each row, which of
    these it has (``own``) and its label; and for each round, as packed bits, whether a row takes part."""

    bins: np.ndarray
    margin: np.ndarray
    own: np.ndarray
    y: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(row, width: int, base: float) -> Block:
        rows = np.frombuffer(row["bins"], np.dtype((np.void, width)))
        distinct, own = np.unique(rows, return_inverse=True)
        parts = np.frombuffer(row["parts"], np.uint8).reshape(-1, (len(rows) + 7) // 8)
        return Block(distinct.view(np.uint8).reshape(-1, width).T.copy(), np.full(len(distinct), base), own.reshape(-1).astype(np.int32),
                     np.frombuffer(row["y"]), parts)


def _binned(rows: DataFrame, key: list[str], inputs: list[str], label: str, cuts: list[list[float]], rounds: int, subsample: float) -> DataFrame:
    """Each input as the number of cuts up to its value, one byte each; a null is in the first bin.  A stored row is a block of rows."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in inputs])
    row_id = F.xxhash64(*[F.col(f"`{k}`") for k in key])
    parts = F.transform(F.sequence(F.lit(0), F.lit(max(0, rounds - 1))),
                        lambda i: F.pmod(F.xxhash64(F.col("id"), i), F.lit(1000)) < round(subsample * 1000))
    chosen = rows.select(values.alias("x"), F.col(f"`{label}`").cast("double").alias("y"), row_id.alias("id")).filter("y is not null")

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bins, y, taken = (np.concatenate(part) for part in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (bins, y, np.packbits(taken.T, axis=1))],
                                          ["bins", "y", "parts"])

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            bins = np.stack([np.searchsorted(own, flat[:, k], "right") for k, own in enumerate(cuts)], axis=1).astype(np.uint8)
            bins[np.isnan(flat)] = 0
            taken = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(len(bins), -1)
            held.append((bins, batch.column("y").to_numpy(), taken))
            n += len(bins)
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return chosen.select("x", "y", parts.alias("parts")).mapInArrow(bin_rows, STATE)


def _moved(trees: list[Tree]) -> Callable[[Block], Block]:
    """A block with the margins that trees leave."""
    def move(block: Block) -> Block:
        margin = block.margin
        for tree in trees:
            margin = margin + np.array(tree.value)[tree.leaves(block.bins)]
        return replace(block, margin=margin)

    return move


def _sums(tree: Tree, nodes: list[int], objective: str, i: int, sizes: list[int]):
    """A task's sums of gradients and hessians of the rows of round ``i``, for each node that is open, input and bin."""
    def add(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        firsts = np.cumsum([0, *sizes])
        at = np.full(len(tree.feature), -1)
        at[nodes] = np.arange(len(nodes))
        sums = np.zeros((2, len(nodes), firsts[-1]))
        for block in blocks:
            taken = np.unpackbits(block.parts[i], count=len(block.y)).view(bool)
            own, y = block.own[taken], block.y[taken]
            slopes = OBJECTIVES[objective].slopes(block.margin[own], y)
            place = at[tree.leaves(block.bins)]
            used = np.flatnonzero(place >= 0)
            # Rows of the same bins are in the same node and cells: they are added up first.
            added, place = [np.bincount(own, x, len(block.margin))[used] for x in slopes], place[used]
            for f, size in enumerate(sizes):
                cells = place * size + block.bins[f, used]
                for k, x in enumerate(added):
                    sums[k, :, firsts[f]:firsts[f + 1]] += np.bincount(cells, x, len(nodes) * size).reshape(-1, size)
        yield sums

    return add


class _Splits:
    """Gains and leaf values from sums of gradients and hessians."""

    def __init__(self, l2: float, least: float, most: float):
        self.l2, self.least, self.most = l2, least, most

    def weight(self, g, h):
        w = -g / (h + self.l2)
        return np.clip(w, -self.most, self.most) if self.most else w

    def gain(self, g, h):
        w = self.weight(g, h)
        return -(2 * g * w + (h + self.l2) * w * w)

    def best(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, input, last bin on the left) of the best split of a node, given its sums by (input, bin)."""
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        all_g, all_h = g[0].sum(), h[0].sum()
        right_g, right_h = all_g - left_g, all_h - left_h
        good = (left_h >= self.least) & (right_h >= self.least)
        if not good.any():
            return None
        gains = np.where(good, self.gain(left_g, left_h) + self.gain(right_g, right_h) - self.gain(all_g, all_h), -np.inf)
        top = gains.max()
        if not top > LEAST_GAIN:
            return None
        feature, last = map(int, np.argwhere(gains >= top - SAME * abs(top))[0])
        return float(gains[feature, last]), feature, last


def _grow(state: RDD, i: int, objective: str, cuts: list[list[float]], depth: int, step: float, gamma: float, splits: _Splits) -> Tree:
    """One tree on the rows of round ``i``.

    A task adds its rows up, as arrays, to one number for each (node, input, bin), whatever their number; these arrays are added
    up in a tree of tasks, and the driver gets the root of their number at most, of 2 ** level x all bins sums each.
    """
    tree, sizes = Tree.root(depth), [len(own) + 1 for own in cuts]
    firsts = np.cumsum([0, *sizes])
    open_nodes = [0]
    for level in range(depth):
        sums = state.mapPartitions(_sums(tree, open_nodes, objective, i, sizes)).treeAggregate(0.0, add, add) + np.zeros((2, len(open_nodes), firsts[-1]))
        g, h = np.zeros((2, len(open_nodes), len(cuts), max(sizes)))
        for f, size in enumerate(sizes):
            g[:, f, :size], h[:, f, :size] = sums[:, :, firsts[f]:firsts[f + 1]]
        split = []
        for k, n in enumerate(open_nodes):
            if not level:
                tree.value[n] = step * float(splits.weight(g[k, 0].sum(), h[k, 0].sum()))
            found = splits.best(g[k], h[k])
            if found is None:
                continue
            tree.gain[n], f, last = found
            tree.feature[n], tree.bin[n], tree.cut[n] = f, last, cuts[f][last]
            for child, own in ((2 * n + 1, slice(None, last + 1)), (2 * n + 2, slice(last + 1, None))):
                tree.value[child] = step * float(splits.weight(g[k, f, own].sum(), h[k, f, own].sum()))
                split.append(child)
        open_nodes = split
        if not open_nodes:
            break
    tree.prune(gamma)
    return tree


def fit_trees(rows: DataFrame, key: list[str], inputs: list[str], label: str, prediction: str, *, objective: str = "squared", rounds: int,
              depth: int, step: float, gamma: float, least: float, subsample: float, l2: float = 1.0, bins: int = 256) -> BoostedTrees:
    """``rounds`` trees, each a second-order step on what the ones before leave.

    A split's gain is what the two sides' squared gradient sums over their hessian sums (plus ``l2``) add to the whole's; each side needs
    a hessian sum of ``least``.  Trees grow to ``depth``, then splits that gain less than ``gamma`` are taken back from the bottom.
    A leaf's value is ``step`` times its Newton step, which is bounded for counts.  Whether a row takes part in a round follows
    from the hash of its ``key``.

    Inputs are binned once, and the bins stored as blocks of rows, which stay in the executors' memory (or on their disks) with the margins.
    Each round makes the margins from those of some rounds before; what a lost executor held is made again from the stored blocks.
    Rows without a label are left out; a null input is smaller than any value.  Without rows, every tree is a leaf of value 0.
    """
    if not 2 <= bins <= 256:
        raise ValueError("an input has 2 to 256 bins")
    kind, spark, width = OBJECTIVES[objective], rows.sparkSession, len(inputs)
    model = BoostedTrees(inputs, prediction, objective, kind.start, depth)
    cuts = cut_points(rows, inputs, bins)
    splits, path = _Splits(l2, least, kind.most), shared_dir(spark, "bins")
    _binned(rows, key, inputs, label, cuts, rounds, subsample).write.parquet(path)
    stored = spark.read.schema(STATE).parquet(path)
    state = start = stored.rdd.map(lambda row: Block.of(row, width, kind.start)).persist(StorageLevel.MEMORY_AND_DISK)
    new, earlier = [], []
    try:
        for i in range(rounds):
            tree = _grow(state, i, objective, cuts, depth, step, gamma, splits)
            model.trees.append(tree)
            new.append(tree)
            # The blocks of this round are held by now; of those before it, only those at ``start`` are read again.
            for held in earlier:
                if held is not start:
                    held.unpersist()
            if i + 1 < rounds:
                earlier = [start, state]
                state = start.map(_moved(new)).persist(StorageLevel.MEMORY_AND_DISK)
                if len(new) == CUT_EVERY:
                    start, new = state, []
    finally:
        for held in {start, state, *earlier}:
            held.unpersist()
    return model
