"""The patterns against plain regular expressions, and what the field adds."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lotflow.llm.pii import KINDS, Span, all_spans, base_spans, find_pii, fit, nodes_of, passes_luhn, train

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else True,
            "card": 16 <= len(digits) <= 19 and passes_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain_spans(text):
    return [Span(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text) if good(k, m[0])]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_against_plain_ones(seed):
    draw = random.Random(seed)
    bits = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "25", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+",
            "+1 (555) 010-9999", "+12", "(", ")", "é", "\n", "0000", "4337166598464399", "%", "@b.c"]
    for _ in range(400):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1" * 1_000_000 + ".1", "1." * 300_000, "@" * 500_000, "a@" * 300_000, "+1" + " " * 500_000, "1 " * 300_000):
        base_spans(text)
    assert time.time() - start < 30


@pytest.fixture(scope="module")
def field(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(("text", "kind", "mention"), [
    ("Call +1 (988) 555-2485 today. Later, 988-555-2485 is shut.", "phone", "988-555-2485"),
    ("Card 4111 1111 1111 1111 was used; " + "word " * 500 + "4111.1111.1111.1111 again", "card", "4111.1111.1111.1111"),
    ("Write to bosbt.42@mail8.example.com. She is known as bosbt.42 here.", "email", "bosbt.42"),
])
def test_the_field_labels_other_mentions(field, text, kind, mention):
    base, spans = all_spans(text, field)
    start = text.rindex(mention)
    assert set(base) <= set(spans)
    assert [s for s in spans if s not in base] == [Span(kind, start, start + len(mention))]


def test_clean_texts_stay_clean(field):
    for text in ("Nothing here at all.", "Order 12345678 of 2024-01-30 10:15", "1234567890 and 1234567890 again", "a@b", "sum 100 200 300 400"):
        assert all_spans(text, field) == ([], [])


def test_an_untrained_field_labels_nothing_alone():
    assert all_spans("1234567 and 1234567", train([])) == ([], [])


def test_mentions_stay_clear_of_overlapping_matches():
    text = ".".join(["1.2.3.4"] * 12) + ".12345678@mail.example.com and 12345678"
    base = base_spans(text)
    assert len(base) > 9
    free = [n for n in nodes_of(text, base) if not n.label]
    assert [text[n.start : n.end] for n in free] == ["12345678"] and free[0].start > text.index("and")


def test_rows(spark, field):
    rows = [(1, "x@y.zz"), (None, None), (2, ""), (2, "é x@y.zz"), (2, "é x@y.zz")]
    docs = spark.createDataFrame([(*r, 0, "b") for r in rows], "doc_id long, text string, start int, base string")
    found = find_pii(docs, field).orderBy(F.col("doc_id").asc_nulls_first(), F.size("base")).collect()
    listed = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in found]
    assert listed == [(None, []), (1, [("email", 0, 6)]), (2, []), (2, [("email", 2, 8)]), (2, [("email", 2, 8)])]
    assert find_pii(docs.limit(0)).count() == 0
