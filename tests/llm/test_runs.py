"""Runs against plain comparisons of every period."""

import numpy as np
import pytest

from lotflow.llm import runs as R
from lotflow.llm.query_runs import digests, with_repeats


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_texts(rng, n):
    out = []
    for _ in range(n):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(0, 130))
        if len(text) and rng.random() < 0.5:
            a = int(rng.integers(len(text)))
            text[a:] = np.resize(text[a : a + 1 + int(rng.integers(len(text) - a)) // 3], len(text) - a)
        out.append(text.astype(np.int64))
    return out


@pytest.mark.parametrize(("times", "candidates"), [(2, 2_000_000), (4, 2_000_000), (3, 10)])
def test_against_every_period(times, candidates, monkeypatch):
    monkeypatch.setattr(R, "BATCH_CANDIDATES", candidates)
    rng = np.random.default_rng(times)
    for _ in range(60):
        texts = some_texts(rng, rng.integers(1, 8))
        for text, found in zip(texts, R.find_runs(texts, 6, times)):
            assert [tuple(r) for r in found.tolist()] == plain_runs(text.tolist(), 6, times)


def test_extensions():
    rng = np.random.default_rng(3)
    texts = some_texts(rng, 30)
    line = np.concatenate([[-1], *[np.append(t, -2 - k) for k, t in enumerate(texts)]])
    grammar = R.Grammar(line)
    # Each two levels leave a constant share of the symbols.
    assert len(grammar.levels) < 12 * np.log2(len(line))
    i, j = rng.integers(0, len(line), (2, 500))
    i, j = i[i != j], j[i != j]
    for a, b, right, left in zip(i, j, grammar.right(i, j), grammar.left(i, j)):
        assert (line[a : a + right] == line[b : b + right]).all() and line[a + right] != line[b + right]
        assert all(line[a - k] == line[b - k] for k in range(left)) and line[a - left] != line[b - left]


def test_many_candidates_of_one_text():
    """One word only, and a word at every other place: every place of a grid is a candidate."""
    assert R.find_runs([np.zeros(50_000, np.int64)])[0].tolist() == [[0, 50_000, 1]]
    assert not len(R.find_runs([np.where(np.arange(50_000) % 2 == 0, 0, np.arange(50_000))])[0])


TEXTS = [(1, "a b a b a b a b c"), (2, None), (3, ""), (4, "  "), (5, "x x x x x"), (6, "x x\tx\nx x x x x"), (7, "y  y y y y y"), (7, "y  y y y y y"),
         (None, "é è é è é è é è"), (8, "a b c " * 40_000 + "end"), (9, "q" * 100_000), (10, "a a a a a a b a a a a a a b a a a a a a b a a a a a a b z")]


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_WORDS", 20)
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in TEXTS], "doc_id long, text string, runs string, n_words int").repartition(3)
    found = R.periodic_runs(docs).collect()
    expected = []
    for i, t in TEXTS:
        words = (t or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(0, 120_000, 3)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        expected.append((i, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in found)
    first = digests(R.periodic_runs(docs)).filter("doc_id = 10").collect()[0]
    assert (first["n_runs"], first["start"], first["length"], first["period"], first["exponent_milli"]) == (5, 0, 28, 7, 4000)


def test_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40)), 1) for i in range(50)] + [(None, None, 1)], "doc_id long, text string, n int")
    changed = {r["doc_id"]: r["text"] for r in with_repeats(docs).collect()}
    import zlib

    for i, t in changed.items():
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0:
            a = h // 10 % 40
            p = 1 + (40 - a) // (3 + h // 10 % 8)
            assert t.split() == [f"w{k if k < a else a + (k - a) % p}" for k in range(40)]
        else:
            assert t is None or t.split() == [f"w{k}" for k in range(40)]
    assert digests(R.periodic_runs(docs.limit(0))).count() == 0
