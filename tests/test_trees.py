"""Boosted trees against a plain learner on few rows."""

import math

import pytest
from pyspark.sql import functions as F

from lotflow.plans import boosted_trees as B

INPUTS, DEPTH, STEP, LEAST, L2 = ["a", "b", "c"], 3, 0.3, 6.0, 1.0


def made(n=500):
    """Rows (id, a, b, c, y): few values of a, nulls in b, c in two values."""
    spread = lambda i, k: (i * 2654435761 >> k) % 1000 / 1000
    out = []
    for i in range(n):
        a, b, c = i * 7 % 12, None if i % 11 == 0 else round(spread(i, 3) * 50, 2), i % 2
        out.append((i, float(a), b, float(c), int(3 * c + (a > 5) * 4 + (b or 0) // 20 + 2 * spread(i, 9))))
    return out


def plain_trees(rows, objective, rounds, gamma):
    """Nested (input, cut, left, right) or leaf values; nulls go left."""
    margin = [B.START if objective == "squared" else math.log(B.START)] * len(rows)
    x = [[-math.inf if v is None else v for v in r[1:4]] for r in rows]
    trees = []

    def weight(g, h):
        w = -g / (h + L2)
        return max(-B.MAX_STEP, min(B.MAX_STEP, w)) if objective == "poisson" else w

    def gain(g, h):
        w = weight(g, h)
        return -(2 * g * w + (h + L2) * w * w)

    for _ in range(rounds):
        if objective == "squared":
            g, h = [m - r[4] for m, r in zip(margin, rows)], [1.0] * len(rows)
        else:
            g, h = [math.exp(m) - r[4] for m, r in zip(margin, rows)], [math.exp(m + B.MAX_STEP) for m in margin]

        def build(own, level):
            total = sum(g[i] for i in own), sum(h[i] for i in own)
            leaf = STEP * weight(*total)
            best = None
            if level < DEPTH:
                for f in range(3):
                    for cut in sorted({x[i][f] for i in range(len(rows)) if x[i][f] > -math.inf})[1:]:
                        left = [i for i in own if x[i][f] < cut]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        rg, rh = total[0] - lg, total[1] - lh
                        if lh >= LEAST and rh >= LEAST:
                            won = gain(lg, lh) + gain(rg, rh) - gain(*total)
                            if won > B.LEAST_GAIN and (best is None or won > best[0] * (1 + 1e-9)):
                                best = won, f, cut, left
            if best is None:
                return leaf
            inside = set(best[3])
            left, right = build(best[3], level + 1), build([i for i in own if i not in inside], level + 1)
            if best[0] < gamma and not isinstance(left, tuple) and not isinstance(right, tuple):
                return leaf
            return best[1], best[2], left, right

        tree = build(list(range(len(rows))), 0)
        trees.append(tree)
        for i in range(len(rows)):
            node = tree
            while isinstance(node, tuple):
                node = node[2] if x[i][node[0]] < node[1] else node[3]
            margin[i] += node
    return trees, margin


def nested(tree, n=0):
    if tree.feature[n] < 0:
        return tree.value[n]
    return tree.feature[n], tree.cut[n], nested(tree, 2 * n + 1), nested(tree, 2 * n + 2)


def alike(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and a[1] == b[1] and alike(a[2], b[2]) and alike(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-9


def size(tree):
    return 1 + size(tree[2]) + size(tree[3]) if isinstance(tree, tuple) else 0


@pytest.mark.parametrize("objective", ["squared", "poisson"])
def test_as_a_plain_learner(spark, objective, monkeypatch):
    monkeypatch.setattr(B, "CUT_EVERY", 2)
    # Every distinct value of b is a cut in both.
    rows = [(i, a, None if b is None else float(int(b)), c, y) for i, a, b, c, y in made()]
    table = spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3)
    sizes = {}
    for gamma in (0.0, 4.0, 60.0):
        model = B.fit_trees(table, ["id"], INPUTS, "y", "p", objective=objective, rounds=4, depth=DEPTH, step=STEP, gamma=gamma, least=LEAST, subsample=1.0, l2=L2)
        expected, margin = plain_trees(rows, objective, 4, gamma)
        assert all(alike(nested(t), e) for t, e in zip(model.trees, expected))
        found = {r["id"]: r["p"] for r in model.transform(table).collect()}
        value = math.exp if objective == "poisson" else lambda m: m
        assert all(abs(found[r[0]] - value(m)) < 1e-9 for r, m in zip(rows, margin))
        sizes[gamma] = sum(map(size, expected))
    # A minimum gain changes the trees.
    assert sizes[60.0] < sizes[0.0]


def test_cut_points(spark):
    rows = spark.range(100_000).select(F.col("id").cast("double").alias("many"), (F.col("id") == 7).cast("int").alias("rare"),
                                       F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"), (F.col("id") % 40).alias("few"))
    many, rare, none, nan, few = B.cut_points(rows, ["many", "rare", "none", "nan", "few"], 64)
    assert 60 <= len(many) <= 64 and many == sorted(many) and many[-1] == 99_999.0
    assert rare == [1.0] and none == nan == [] and len(few) in (39, 40)


def test_rates_and_no_rows(spark):
    rows = spark.range(2000).select(
        F.col("id"), (F.col("id") % 2).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(4 + F.col("id") % 5).cast("bigint").alias("y"))
    fit = lambda table: B.fit_trees(table, ["id"], ["x"], "y", "mu", objective="poisson", rounds=25, depth=2, step=0.4, gamma=0.0, least=1.0, subsample=0.8)
    found = {r["x"]: r["mu"] for r in fit(rows).transform(rows).groupBy("x").agg(F.avg("mu").alias("mu")).collect()}
    assert abs(found[0.0] - 1.0) < 0.1 and abs(found[1.0] - 6.0) < 0.2
    unlabelled = fit(rows.limit(5).withColumn("y", F.lit(None).cast("long")))
    assert {r["mu"] for r in unlabelled.transform(rows).collect()} == {B.START}


def test_rows_are_stored_once_in_blocks(spark, monkeypatch):
    """Blocks of rows, written once however many rounds; rows of the same bins are worked on once."""
    folders, own = [], B.shared_dir
    monkeypatch.setattr(B, "shared_dir", lambda *a: folders.append(own(*a)) or folders[-1])
    monkeypatch.setattr(B, "CUT_EVERY", 2)
    rows = spark.range(0, 4000, 1, 2).select("id", (F.col("id") % 2).alias("x"), (F.col("id") % 2 * 3 + F.col("id") % 3).alias("y"))
    model = B.fit_trees(rows, ["id"], ["x"], "y", "p", rounds=7, depth=2, step=0.3, gamma=0.0, least=1.0, subsample=0.8)
    (folder,) = folders
    blocks = spark.read.schema(B.STATE).parquet(folder).collect()
    assert len(blocks) == 2 and len(model.trees) == 7
    block = B.Block.of(blocks[0], 1, 0.5)
    assert block.bins.shape == (1, 2) and len(block.margin) == 2 and len(block.y) == 2000 and block.parts.shape == (7, 250)
    assert sum(len(block.y) for block in (B.Block.of(b, 1, 0.5) for b in blocks)) == 4000
