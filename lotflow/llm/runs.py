"""Periodic runs of words by recompression: grammar queries extend what the harmonic grid proposes, without suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import mixed, prepare

#: Words that are searched together; a longer text is searched alone.
BATCH_WORDS = 1_000_000
#: Candidates that are extended together.
BATCH_CANDIDATES = 2_000_000


class Grammar:
    """A run-length grammar of a sequence, level by level; symbols below 0 (each used once) are never joined to others.

    A level is (symbols, begins): ``begins`` marks the symbols that begin one of the next level's.  Even levels put blocks
    of one symbol together, odd ones pairs of a left and a right symbol, as a hash of the symbol deals them.  Both depend on
    a symbol's neighbours alone, so equal stretches are put together alike but for their ends.  Equal symbols stand
    for equal sequences.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = int(symbols.max(initial=0)) + 1
        while True:
            joined = (symbols[1:] >= 0) & (symbols[:-1] >= 0)
            if not joined.any():
                break
            begins = np.ones(len(symbols), bool)
            if len(self.levels) % 2 == 0:
                begins[1:] = symbols[1:] != symbols[:-1]
            else:
                right = (mixed(symbols.astype(np.uint64) + np.uint64(len(self.levels) << 40)) & np.uint64(1)).astype(bool)
                begins[1:] = ~(joined & ~right[:-1] & right[1:])
            self.levels.append((symbols, begins))
            down = np.flatnonzero(begins)
            size = np.diff(down, append=len(symbols))
            several = np.flatnonzero(size > 1)
            first = symbols[down[several]]
            # A block is told by its symbol and size, a pair by both symbols: two numbers below 2 ** 31.
            second = size[several] if len(self.levels) % 2 else symbols[down[several] + 1]
            rules, which = np.unique(first << 32 | second, return_inverse=True)
            symbols = symbols[down]
            symbols[several] = fresh + which
            fresh += len(rules)
        self.top = symbols
        self.forward = _Extension(self.levels, self.top)
        self.backward = _Extension([(s[::-1], np.append(b[1:], True)[::-1]) for s, b in self.levels], self.top[::-1])

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on are those from j on."""
        return self.forward.length(i, j)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i, backwards, are those up to j."""
        last = len(self.levels[0][0]) - 1 if self.levels else len(self.top) - 1
        return self.backward.length(last - i, last - j)


class _Extension:
    """Longest common extensions to the right, of many pairs of different places at once.

    A query climbs while its places hold equal symbols: at most one pair's second half, or the rest of a block, has to be
    stepped over before both places begin symbols of the next level.  Where symbols differ it goes down again, stepping
    over what is equal on each level.  At the bottom both places hold different symbols.  Every sequence ends by a symbol that
    occurs once, so no query runs off the end.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray):
        self.levels = []
        for k, (symbols, begins) in enumerate(levels):
            up = np.cumsum(begins) - 1
            down = np.flatnonzero(begins)
            # What may be stepped over at once: the rest of a block, one symbol of a pair.
            rest = np.append(down, len(symbols))[up + 1] - np.arange(len(symbols)) if k % 2 == 0 else np.ones(len(symbols), np.int64)
            self.levels.append((symbols, begins, up, down, rest))
        self.top = top

    def length(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, query = i.astype(np.int64), j.astype(np.int64), np.arange(len(i))
        stopped = []
        for symbols, begins, up, _, rest in self.levels:
            stop, climb = [], []
            while len(query):
                equal = symbols[x] == symbols[y]
                stop.append((x[~equal], y[~equal], query[~equal]))
                x, y, query = x[equal], y[equal], query[equal]
                both = begins[x] & begins[y]
                climb.append((up[x[both]], up[y[both]], query[both]))
                x, y, query = x[~both], y[~both], query[~both]
                step = np.minimum(rest[x], rest[y])
                x, y = x + step, y + step
            stopped.append(_together(stop))
            x, y, query = _together(climb)
        x, y = _steps(x, y, self.top, None)
        for (symbols, _, _, down, rest), (xs, ys, queries) in zip(self.levels[::-1], stopped[::-1]):
            x, y, query = np.concatenate((down[x], xs)), np.concatenate((down[y], ys)), np.concatenate((query, queries))
            x, y = _steps(x, y, symbols, rest)
        out = np.empty(len(i), np.int64)
        out[query] = x
        return out - i


def _together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3))


def _steps(x: np.ndarray, y: np.ndarray, symbols: np.ndarray, rest: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Both places moved on to the first different symbols of a level."""
    at = np.flatnonzero(symbols[x] == symbols[y])
    while len(at):
        step = 1 if rest is None else np.minimum(rest[x[at]], rest[y[at]])
        x[at] += step
        y[at] += step
        at = at[symbols[x[at]] == symbols[y[at]]]
    return x, y


def grid_candidates(symbols: np.ndarray, longest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, whether the grid place before isn't a candidate) of every place of the harmonic grid that may lie in a run.

    The grid of a period are its multiples.  A run of ``times`` periods holds that many consecutive places of the grid, with one
    symbol at all of them; only the first of such places are candidates.
    """
    found, n = [], 0
    for period in range(1, longest // times + 1):
        line = symbols[::period]
        equal = line[1:] == line[:-1]
        every = equal[: len(equal) - times + 2].copy()
        for k in range(1, times - 1):
            every &= equal[k : len(equal) - times + 2 + k]
        at = np.flatnonzero(every)
        if len(at):
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) > 1
            found.append((at * period, np.full(len(at), period), head))
            n += len(at)
            if n >= BATCH_CANDIDATES:
                yield tuple(map(np.concatenate, zip(*found)))
                found, n = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def _extended(grammar: Grammar, place: np.ndarray, period: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches around candidates."""
    reach = grammar.right(place[head], place[head] + period[head])
    # A candidate that its chain's first one reaches lies in the same stretch.
    chain = np.cumsum(head) - 1
    other = ~head & (place >= (place[head] + reach)[chain])
    places, periods = np.concatenate((place[head], place[other])), np.concatenate((period[head], period[other]))
    reach = np.concatenate((reach, grammar.right(place[other], place[other] + period[other])))
    back = grammar.left(places - 1, places + periods - 1)
    return places - back, places + reach + periods, periods


def find_runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """Of each sequence of numbers from 0 on: its runs as rows (start, length, period), by start, then period.

    A run is a stretch of ``least`` symbols and ``times`` of its smallest periods at least that can't be made longer keeping the
    period.
    """
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    longest = int(sizes.max(initial=0))
    if longest < max(least, times):
        return [none] * len(texts)

    def chained(chosen):
        """The chosen texts in one, with a symbol of its own at the start and after each; and where they start."""
        parts = [np.array([-1])]
        for k in chosen:
            parts += [texts[k], np.array([-2 - k])]
        return np.concatenate(parts), np.cumsum(np.concatenate(([1], sizes[chosen] + 1)))[:-1]

    every, offsets = chained(np.arange(len(texts)))
    # Most texts have no candidate, and then no run: they need no grammar.
    has = np.zeros(len(texts), bool)
    for place, _, _ in grid_candidates(every, longest, times):
        has[np.searchsorted(offsets, place, "right") - 1] = True
    chosen = np.flatnonzero(has)
    if not len(chosen):
        return [none] * len(texts)
    some, offsets = chained(chosen)
    grammar = Grammar(some)
    found = np.zeros((0, 3), np.int64)
    for candidates in grid_candidates(some, int(sizes[chosen].max()), times):
        start, end, period = _extended(grammar, *candidates)
        good = end - start >= np.maximum(least, times * period)
        rows = np.concatenate((found, np.stack((start[good], end[good], period[good]), axis=1)))
        # A stretch with a period has its multiples, too: the smallest counts.
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        found = rows[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(offsets, found[:, 0], "right") - 1
    rows = np.stack((found[:, 0] - offsets[text], found[:, 1] - found[:, 0], found[:, 2]), axis=1)
    out = [none] * len(texts)
    for k, own in zip(chosen.tolist(), np.split(rows, np.searchsorted(text, np.arange(1, len(chosen))))):
        out[k] = own
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(least: int, times: int, most: int):
    def batch_of(ids, texts):
        numbers: dict[bytes, int] = {}
        coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
        runs = find_runs(coded, least, times)
        flat = np.concatenate(runs)
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
        columns = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
        collapsed = pa.array([_collapsed(t, r) for t, r in zip(texts, runs)], pa.large_binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, fields=list(_RUN))), collapsed.cast(pa.large_string()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                # Without an argument, bytes are cut at these six characters.
                words = (text.as_py() or b"").split()
                if n and n + len(words) > most:
                    yield batch_of(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(name)
                texts.append(words)
                n += len(words) + 1
        if ids:
            yield batch_of(ids, texts)

    return search


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: the runs of its text's words (``[^\\x20\\x09-\\x0D]+``, numbered from 0) by start,
    then period, and the text without the repeats: the words that no run contains after its first period, joined by spaces.

    A run has ``least`` words and ``times`` of its smallest periods at least.  The harmonic grid proposes places, a run-length grammar
    by recompression says exactly how far they extend both ways, and of a stretch's periods the smallest counts.  Texts are
    searched where they are, many at once, with no shuffle; the work on a text of n words is about n log n.

    Null and empty texts have no words, no runs and an empty collapsed text.  Rows are never told apart by doc_id, so null and
    repeated ids do no harm; other columns are ignored.  No rows give no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(least, times, BATCH_WORDS), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
