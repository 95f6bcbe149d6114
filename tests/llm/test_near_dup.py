"""Near-duplicates against brute force."""

import json
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lotflow.llm import cover_tree
from lotflow.llm.cover_tree import near_duplicate_vectors
from lotflow.llm.graph import components
from lotflow.llm.minhash import near_duplicates


def roots(nodes, links):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def expected_documents(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}


def corpus(seed):
    """Texts with edited copies: chains of edits, a large group around one text, exact copies, edges of every kind."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(4))
    texts = [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(40)]
    base = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(60)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(80)]
    for _ in range(12):
        chain = list(chain)
        chain[draw.randrange(80)] = word()
        texts.append("\n".join(chain))
    texts += [base[0].upper(), base[0], "", None, " \t\n", "one two", "ONE\ttwo", "one two three four", " ".join(base).upper()]
    texts.append(" ".join(word() for _ in range(30_000)))
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_documents_against_all_pairs(spark, width, percent):
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "x", i, i) for i, t in rows], "doc_id long, text string, key string, id int, component long")
    found = {r["doc_id"]: r for r in near_duplicates(docs, width, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected_documents(rows, width, percent)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_documents_without_id_or_repeated(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, "A B c d e"), (None, None), (None, "z y x w"), (9, "")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in found) == sorted(map(str, [
        (None, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (None, None, True), (None, None, True), (9, 9, True)]))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_stars_paths_and_noise(spark):
    draw = random.Random(2)
    links = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    links += [(7, 7), (None, 3), (310, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    good = [(a, b) for a, b in links if a is not None and a != b]
    assert found == roots({n for link in good for n in link}, good)


def expected_vectors(rows, cosine):
    units = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float) / np.abs(v).max()
            units[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine]
    degree = dict.fromkeys([i for i, _ in rows], 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], r) for i, r in roots(list(degree), links).items()}


@pytest.mark.parametrize("block", [16, 64])
def test_vectors_against_all_pairs(spark, block):
    draw = np.random.default_rng(block)
    rows = [draw.standard_normal(8) for _ in range(120)]
    centre = draw.standard_normal(8)
    # A tight group that is linked as a whole, a looser one, exact copies, and scaled ones.
    rows += [centre + 0.01 * draw.standard_normal(8) for _ in range(80)]
    rows += [rows[0] + 0.25 * draw.standard_normal(8) for _ in range(60)]
    rows += [centre] * 20 + [centre * 1e200, centre * 1e-200]
    rows = [r.tolist() for r in rows] + [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [1.0, 2.1]]
    rows = list(enumerate(rows))
    data = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, block string, n int")
    found = near_duplicate_vectors(data, 0.95, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == expected_vectors(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize(("cosine", "cell", "block"), [(0.95, 4, 2048), (0.95, 4, 8), (0.8, 2, 2048), (0.5, 8, 4)])
def test_vectors_across_cells(spark, cosine, cell, block, monkeypatch):
    draw = np.random.default_rng(cell)
    rows = [draw.standard_normal(6) for _ in range(150)]
    # Pairs halfway between cells, a group wider than a cell, tight groups, and vectors of a second length.
    rows += [(rows[k] + rows[k + 1]) / 2 + 0.05 * draw.standard_normal(6) for k in range(0, 100, 2) for _ in range(2)]
    rows += [rows[0] + 0.4 * draw.standard_normal(6) for _ in range(60)] + [rows[1] + 0.01 * draw.standard_normal(6) for _ in range(40)]
    rows += [draw.standard_normal(3) for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    # Many tasks that hold little.
    for name, value in {"HELD": 2000, "LEAST_PAIRS": 5000}.items():
        monkeypatch.setattr(cover_tree, name, value)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near_duplicate_vectors(data, cosine, block=block, cell=cell).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == expected_vectors(rows, cosine)


def test_vectors_empty_repeated_and_without_id(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])]
    found = near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]))


def test_vectors_move_once(tmp_path):
    """The bytes that a query of its own shuffles, by Spark's event log: not more with every pair of blocks that may be near."""
    script = f"""
import numpy as np, pyarrow as pa, pyarrow.parquet as pq
from pyspark.sql import SparkSession
from lotflow.llm.cover_tree import near_duplicate_vectors
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config(
    "spark.eventLog.compress", "false").config("spark.eventLog.dir", {(tmp_path / "log").as_uri()!r}).config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config(
    "spark.sql.shuffle.partitions", "4").getOrCreate()
rows = np.random.default_rng(1).standard_normal((6000, 64)).astype(np.float32)
pq.write_table(pa.table({{"vec_id": range(len(rows)), "embedding": list(rows)}}), {str(tmp_path / "vectors.parquet")!r})
assert near_duplicate_vectors(spark.read.parquet({str(tmp_path / "vectors.parquet")!r}), block=256).filter("kept").count() == len(rows)
spark.stop()
"""
    (tmp_path / "log").mkdir()
    paths = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH")]))
    subprocess.run([sys.executable, "-c", script], check=True, env=os.environ | {"PYTHONPATH": paths}, timeout=300)
    events = [json.loads(line) for f in (tmp_path / "log").rglob("events_*") for line in f.open()]
    ends = [e for e in events if e["Event"] == "SparkListenerTaskEnd"]
    assert len(ends) > 10
    assert sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in ends) < 2 * 6000 * 64 * 4
