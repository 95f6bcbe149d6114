"""The round trip against the tokenizer itself."""

from lotflow.llm.bpe import decode, encode, encode_decode, tokenizer, words_of
from lotflow.llm.query_bpe import digests, vocabulary

TEXTS = [
    "", None, " ", "\n\n a", "Hello  world\n\n  it's  we'll I'd'd 123abc", "é ñ 漢字 かな 한국 🙂👩‍👩‍👧 á", "<|endoftext|> x<|endoftext|><|endoftext|>y <|endoftext",
    "tab\there\r\nnew space end ", "՘!֋ a꟎!꟎ 1՘ \U0001fae8⿿", "\x00\x01\x7f", "a" * 5000, "word " * 20_000, "'s's 't", "one two", "one two",
]


def test_against_the_tokenizer(spark):
    path = vocabulary()
    rows = [(i, t, b"x", i) for i, t in enumerate(TEXTS)] + [(None, "no id", b"", 0), (3, "a repeated id", b"", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word binary, number int").repartition(3)
    coded = encode_decode(docs, path)
    found = sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in coded.collect())
    plain = [(str(r[0]), tokenizer(path).encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert found == sorted((i, tuple(ids), tokenizer(path).decode(ids, skip_special_tokens=False)) for i, ids in plain)
    assert {r["n_tokens"] for r in digests(coded).collect()} == {len(ids) for _, ids in plain}
    again = decode(encode(docs, path), path)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in again.collect()) == sorted((i, t) for i, _, t in found)


def test_words_join_to_the_text():
    for text in filter(None, TEXTS):
        assert "".join(words_of(text, vocabulary())) == text


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, vocabulary()).count() == 0


def test_ids_that_end_inside_a_character(spark):
    path = vocabulary()
    whole = [tokenizer(path).encode(t, add_special_tokens=False).ids for t in ("🙂", "a 漢字 🙂👩‍👩‍👧 é", "x🙂y")]
    cut = [ids[a:b] for ids in whole for a in range(len(ids)) for b in range(a, len(ids) + 1)]
    rows = spark.createDataFrame(list(enumerate(cut)), "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in decode(rows, path).collect()}
    assert found == {k: tokenizer(path).decode(ids, skip_special_tokens=False) for k, ids in enumerate(cut)}


def test_the_driver_does_not_load_the_vocabulary(spark):
    path = vocabulary()
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    tokenizer.cache_clear()
    coded = encode_decode(docs, path)
    assert decode(coded.select("doc_id", "ids"), path).count() == coded.count() == 2
    assert tokenizer.cache_info().currsize == 0
