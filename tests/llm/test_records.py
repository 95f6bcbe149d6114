"""Record files against the tokenizer, plain checksums and damaged bytes."""

import os
import zlib

import numpy as np
import pytest

from lotflow.llm import records as R
from lotflow.llm.bpe import tokenizer
from lotflow.llm.query_bpe import vocabulary
from lotflow.llm.catalog import QUERIES


def plain_checksum(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (R.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    data[:3000] = 0
    starts = rng.integers(0, 15_000, 40)
    ends = starts + np.concatenate(([4, 5, 511, 512, 513, 1024, 4999], rng.integers(4, 3000, 33)))
    spans = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert R.checksums(spans).tolist() == list(map(plain_checksum, spans))
    assert R.checksums([b"123456789"]).tolist() == [0xE3069283]


def test_frames_and_damage():
    rows = [b"abcd", b"x" * 3000, bytes(12)]
    data, ends = R.framed(rows)
    assert R.unframed(data, ends) == rows and R.frame_ends(data).tolist() == ends.tolist()
    # A frame as other readers of this format expect it.
    assert data[:8] == (4).to_bytes(8, "little")
    crc = plain_checksum(data[:8])
    assert int.from_bytes(data[8:12], "little") == ((crc >> 15 | crc << 17) + R.MASK) % (1 << 32)
    for k in (2, 9, 13, 17, 25, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(R.BadRecord):
            R.unframed(bytes(bad), ends)


TEXTS = ["", None, "Hello  world\n\n  it's 123abc", "é ñ 漢字 🙂", "<|endoftext|> x", "a" * 5000, "word " * 20_000, "one two", "one two", " \n"]


@pytest.fixture
def rows():
    return [(10 - i, t, "f", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "f", 1), (None, None, "f", 1), (5, "a repeated id", "f", 1), (-3, "below 0", "f", 1)]


def expected(rows):
    coded = [(i, [*tokenizer(vocabulary()).encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows]
    return sorted(coded, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize(("file_bytes", "chunk"), [(1 << 28, 1 << 22), (100, 50)])
def test_write_and_read(spark, tmp_path, rows, file_bytes, chunk, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, offset int").repartition(3)
    folder = f"file://{tmp_path}/made"
    os.mkdir(f"{tmp_path}/made")
    open(f"{tmp_path}/made/part-000000-0000-lost.records", "wb").write(b"of an attempt that failed")
    index = R.write_records(docs, folder, vocabulary(), 0, file_bytes)
    files = sorted(f for f in os.listdir(f"{tmp_path}/made") if f.endswith(".records"))
    assert files == sorted({r["file"] for r in index.collect()}) and (len(files) > 3) == (file_bytes == 100)
    by_id = lambda found: sorted(((r["doc_id"], r["ids"]) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = sorted(expected(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    stored = R.with_ids(R.read_records(index, folder)).collect()
    assert by_id(stored) == whole
    in_order = [r["doc_id"] for r in sorted(stored, key=lambda r: (r["file"], r["offset"]))]
    assert in_order == [i for i, _ in expected(rows)]
    # From the files alone: the same index.
    again = R.rebuilt_index(spark, folder, files).collect()
    assert sorted(map(str, again)) == sorted(map(str, index.select("file", "offset", "bytes", "n_tokens", "doc_id").collect()))
    shuffled = [[(r["file"], r["offset"]) for r in R.read_records(index, folder, seed).collect()] for seed in (1, 1, 2)]
    assert shuffled[0] == shuffled[1] != shuffled[2] and sorted(shuffled[0]) == sorted(shuffled[2])
    assert by_id(R.with_ids(R.read_records(index, folder, 1)).collect()) == whole


def test_query(spark, sf_dir, tmp_path, rows):
    spark.createDataFrame([(i, t) for i, t, *_ in rows if i is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at, plain = 0, []
    for i, ids in expected([r for r in rows if r[0] is not None]):
        plain.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op11_record_files"](spark, str(tmp_path)).collect()]
    alone = lambda rows: sorted(r for r in rows if r[0] != 5)
    # Which of an id's two documents comes first is up to their texts' hash.
    assert alone(found) == alone(plain) and sorted((r[0], *r[2:]) for r in found) == sorted((r[0], *r[2:]) for r in plain)


def test_words_of_one_hash(monkeypatch):
    """Texts whose words a hash doesn't tell apart go to the tokenizer, in one run of texts and in the next."""
    texts = ["alpha beta", "gamma  alpha", "beta gamma 12", "", "été alpha"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    hashes = R.span_hashes
    monkeypatch.setattr(R, "span_hashes", lambda *a: (hashes(*a)[0] % np.uint64(3), hashes(*a)[1]))
    coder = R.Encoder(vocabulary())
    for _ in range(2):
        found = [np.frombuffer(c, coder.type).tolist() for c in coder.encode(data, offsets)]
        assert found == [tokenizer(vocabulary()).encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(R, "WORDS_KEPT", 0)
    assert [np.frombuffer(c, coder.type).tolist() for c in coder.encode(data, offsets)] == found


def test_no_rows(spark, tmp_path):
    index = R.write_records(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", vocabulary())
    assert index.count() == 0 and R.read_records(index, f"{tmp_path}/none").count() == 0
