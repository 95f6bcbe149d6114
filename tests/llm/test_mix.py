"""Water-filling against a plain loop."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from lotflow.llm.mixing import PREFIX, _ranked, mix, mixed_documents


def plain_targets(sizes, share=1.5, epochs=2):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] >= epochs * sizes[s]]
        if not over:
            return {s: float(epochs * sizes[s]) if s in clamped else target[s] for s in names}
        clamped.update(over)


def rows_of(seed):
    draw = random.Random(seed)
    rows = [(i, " ".join("w" * draw.randint(1, 3) for _ in range(draw.choice([0, 1, 5, 40, 300]))),
             draw.choice(["a", "a", "a", "b", "é", "z", "Z", None])) for i in range(300)]
    return rows + [(300, None, "a"), (301, "x y", "tiny"), (302, "", "nothing"), (303, "word " * 5000, "b"), (None, "no id", "b")]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, target int, times double")
    found = mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    target = plain_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    assert len(found) == len(rows)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["times"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert found == mix(docs.repartition(5)).collect() or sorted(map(str, found)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    copies = Counter(r["doc_id"] for r in mixed_documents(docs).collect())
    assert mixed_documents(docs).columns == docs.columns
    assert copies == Counter({r["doc_id"]: r["times"] for r in found if r["times"]})


def test_the_order_is_by_hash_and_whole(spark):
    rows = [(i, "a b c", "s") for i in range(50)] + [(100 + i, "a b c", "t") for i in range(50)]
    found = {r["doc_id"]: r["taken"] for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # 450 words: 300 for s, its cap; the rest for t.
    assert all(found[i] == 6 for i in range(50))
    order = sorted(range(100, 150), key=lambda i: hashlib.md5(f"mix\x1f{i}".encode()).hexdigest())
    assert all(found[i] == 3 for i in order)


@pytest.mark.parametrize("doc_id", [7, None])
def test_part_of_equal_rows(spark, doc_id):
    rows = [(doc_id, "a b c", "a")] * 100 + [(i, "w " * 1000, "z") for i in range(1000, 1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    target = plain_targets({"a": 300, "z": 1000}, share=0.5)["a"]
    found = mix(docs, share=(1, 2)).filter("size = 3").collect()
    assert len(found) == 100 and abs(sum(r["taken"] for r in found) - target) <= 1.5
    texts = Counter(r["text"] for r in mixed_documents(docs, share=(1, 2)).collect())
    assert 3 * texts["a b c"] == sum(r["taken"] for r in found)


def test_rows_without_id_are_spread(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), F.lit("s").alias("source"))
    assert _ranked(docs, "mix").select(F.substring("_place.rank", 1, PREFIX)).distinct().count() > 800
    taken = mix(docs, share=(1, 3)).agg(F.sum("taken")).first()[0]
    assert abs(taken - 2000 / 3) <= 1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
