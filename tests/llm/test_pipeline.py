"""Each stage of the pipeline against a plain version on what its predecessor kept."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as P
from lotflow.llm.bpe import tokenizer
from lotflow.llm.query_bpe import vocabulary
from lotflow.llm.query_mix import mix_sql
from lotflow.llm.query_near_dup import near_dup_sql
from lotflow.llm.query_web import line_sql

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, and a connection that knows them as s0 (the documents) to s4."""
    con = duckdb.connect()
    con.execute(f"create view s0 as select * from '{SF}/documents.parquet'")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES, 1):
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        con.execute(f"create view s{k} as select * from '{path}/*.parquet'")
        found.append(docs)
    return con, found


def ids(con, sql):
    return Counter(r[0] for r in con.execute(sql).fetchall())


def test_stages_keep_the_columns(stages):
    _, found = stages
    assert all(docs.columns == COLUMNS for docs in found[:-1])


def test_quality_keeps_the_good(stages):
    con, _ = stages
    labels = f"'{SF}/labels.parquet'"
    n_good, kept_good = con.execute(f"select count(*), count(s1.doc_id) from {labels} l join s0 using (doc_id) left join s1 using (doc_id) where quality = 1").fetchone()
    n_bad, kept_bad = con.execute(f"select count(*), count(s1.doc_id) from {labels} l join s0 using (doc_id) left join s1 using (doc_id) where quality = 0").fetchone()
    assert kept_good >= 0.98 * n_good and kept_bad <= 0.1 * n_bad
    assert con.execute("select count(*) from s1 join s0 using (doc_id) where s1.text <> s0.text").fetchone() == (0,)


def test_lines(stages):
    con, _ = stages
    want = con.execute(f"with {line_sql('s1')} select doc_id, text from cleaned order by doc_id").fetchall()
    assert con.execute("select doc_id, text from s2 order by doc_id").fetchall() == want
    assert con.execute("select count(*) from s2 where n_chars <> length(text)").fetchone() == con.execute("select count(*) from s1 where n_chars <> length(text)").fetchone()


def test_near_duplicates(stages):
    con, _ = stages
    want = ids(con, f"with recursive {near_dup_sql(5, 80, 's2')} select node from named where node = component")
    assert ids(con, "select doc_id from s3") == want and len(want) < con.execute("select count(*) from s2").fetchone()[0]


def test_mix(stages):
    con, _ = stages
    want = con.execute(f"with {mix_sql('s3')} select doc_id, cast(times as int) from mixed where times > 0").fetchall()
    assert ids(con, "select doc_id from s4") == Counter(dict(want))


def test_bpe(stages):
    con, found = stages
    t = tokenizer(vocabulary())
    want = Counter()
    for doc_id, text in con.execute("select doc_id, text from s4").fetchall():
        coded = t.encode(text, add_special_tokens=False).ids
        want[doc_id, tuple(coded), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in found[-1].collect()) == want
    assert found[-1].filter("n_tokens <> size(ids)").isEmpty()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows, and no documents at all."""
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "b", None), (3, "x " * 50_000, "en", "a", 100_000)]
    for k, rows in enumerate((odd, [])):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= 2 * len(rows)


def test_a_footer_below_a_tenth_of_its_source_is_cut(spark):
    """On 6 of 100 pages a line is boilerplate, on 5 it stays."""
    text = lambda i: "\n".join([f"page {i}"] + ["footer"] * (i < 6) + ["Yes."] * (i < 5))
    docs = spark.createDataFrame([(i, text(i), "en", "a", 0) for i in range(100)], SCHEMA)
    found = [r["text"] for r in P.line_dedup(spark, docs, SF).collect()]
    assert not any("footer" in t for t in found) and sum("Yes." in t for t in found) == 5


def test_copies_without_or_with_the_same_id(spark, tmp_path):
    long = lambda word, n=60: " ".join(f"{word}{k}" for k in range(n))
    rows = [(5, long("a")), (None, long("a")), (None, long("a") + " end"), (5, long("a")), (7, long("a") + " end"),
            (None, long("b")), (None, long("b")), (None, long("b") + " end"), (9, long("c")), (9, long("c")), (None, long("d")),
            (8, ""), (8, ""), (None, None), (None, None), (None, ""), (10, None), (11, long("e")), (11, long("f"))]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "en", "ab"[k % 2], k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(4).write.parquet(path)
    found = P.near_dedup(spark, spark.read.parquet(path), SF)
    assert found.columns == COLUMNS
    kept = Counter((r["doc_id"], r["text"]) for r in found.collect())
    b = {t for i, t in kept if i is None and (t or "").startswith("b")}
    assert len(b) == 1 and b < {long("b"), long("b") + " end"}
    want = [(5, long("a")), (None, b.pop()), (9, long("c")), (None, long("d")), (8, ""), (None, None), (None, ""), (10, None),
            (11, long("e")), (11, long("f"))]
    assert kept == Counter(want)
