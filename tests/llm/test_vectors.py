"""Product codes against plain loops over every entry."""

import math

import numpy as np
import pytest

from lotflow.llm.query_vectors import ENTRIES, PARTS, ROUNDS
from lotflow.llm.vector_codes import Slices, compress, decode


def plain(rows, parts, entries, rounds):
    """(id, code, error) of every kept row, and the entries."""
    kept = [(i, v) for i, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 26 for x in v)]
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept]
    books = [[c[p] for _, c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        best = [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, c in cut]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [c[p] for (_, c), b in zip(cut, best) if b[p][1] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, bytes(k for _, k in b), sum(d for d, _ in b)) for (i, _), b in zip(cut, best)], books


@pytest.mark.parametrize("spread", [3, 400])
def test_nearest(spread):
    """Few distinct values make many ties."""
    rng = np.random.default_rng(spread)
    entries, points = rng.integers(-spread, spread, (64, 4)), rng.integers(-2 * spread, 2 * spread, (2000, 4))
    index, distance = Slices(entries).nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_against_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=32) * (1 if i % 3 else 0.01)]) for i in rng.permutation(150)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (200, [0.0] * 32), (201, None), (202, []), (203, [math.nan] * 32), (204, [None] * 32),
             (205, [math.inf] * 32), (206, [1e300] * 32), (207, [1.0] * 16), (208, [1.0] * 33), (209, [-1e-9] * 32)]
    table = spark.createDataFrame([(i, v, "x", b"y", 1.5) for i, v in rows], "vec_id long, embedding array<double>, error string, point binary, row double").repartition(5)
    codes, books = compress(table, PARTS, 20, ROUNDS)
    expected, entries = plain(rows, PARTS, 20, ROUNDS)
    assert books.entries.tolist() == entries
    assert sorted(codes.columns) == ["code", "error", "row", "vec_id"]
    found = [(r["vec_id"], bytes(r["code"]), r["error"]) for r in codes.collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    back = {r["vec_id"]: r["vector"] for r in decode(codes, books).collect()}
    far = sum((256 * a - math.floor(256 * b)) ** 2 for a, b in zip(back[200], [0.0] * 32))
    assert far == next(e for i, _, e in expected if i == 200)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, books = compress(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.25] * 16, None)], schema), PARTS, ENTRIES, ROUNDS)
    assert books.entries.shape == (16, 2, 1) and {r["error"] for r in codes.collect()} == {0}
    codes, books = compress(spark.createDataFrame([(1, None, 1)], schema), PARTS, ENTRIES, ROUNDS)
    assert codes.count() == 0 and books is None
