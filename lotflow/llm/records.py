"""Token ids in files of length-delimited binary records, with an index of offsets for reads in any order.

A record is framed as: length of the data (unsigned 64 bits), masked checksum of these 8 bytes (32 bits), data, masked checksum of
the data (32 bits), all little-endian; the checksum is CRC-32C, rotated right by 15 bits plus a constant.  The data are
the doc_id (signed 64 bits), whether there is one (16 bits: 1 or 0), the bytes of an id (16 bits) and the ids (unsigned, of 2 bytes each
if all of the vocabulary fit, else 4).
"""

from __future__ import annotations

import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotflow.llm.bpe import byte_of, cut_texts, span_hashes, tokenizer
from lotflow.llm.common import flat_texts, prepare

#: Fixed values of CRC-32C and of its mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes before and after a record's data, and of its data before the ids.
HEAD, TAIL, NAME = 12, 4, 12
#: Distinct words whose ids a worker keeps at hand.
WORDS_KEPT = 3 << 19
#: Bytes that a task gathers before it writes, and that it reads at once unless one record is longer.
CHUNK = 1 << 22
#: Bytes of records that one task reads.
READ = 1 << 25
_BLOCK = 512


@lru_cache(maxsize=2)
def id_bytes(path: str) -> int:
    return 2 if max(tokenizer(path).get_vocab().values()) < 1 << 16 else 4


@lru_cache(maxsize=1)
def _step_table() -> np.ndarray:
    """What two bytes do to a checksum."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@lru_cache(maxsize=1)
def _block_tables() -> list[np.ndarray]:
    """What a block of zeros does to a checksum, for each of its four bytes."""
    tables = []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_BLOCK // 2):
            state = (state >> 16) ^ _step_table()[state & 0xFFFF]
        tables.append(state)
    return tables


def checksums(spans: list[bytes]) -> np.ndarray:
    """CRC-32C of spans of at least four bytes.

    Spans are padded on the left by zeros, which change nothing before the first byte that isn't one, and cut into blocks.  All
    blocks go through the table side by side; a span's blocks are then put together from the left.
    """
    lengths = np.array([len(s) for s in spans], np.int64)
    blocks = -(-lengths // _BLOCK)
    first = np.cumsum(blocks) - blocks
    into = first * _BLOCK + blocks * _BLOCK - lengths
    zeros = bytes(_BLOCK)
    padded = np.frombuffer(bytearray().join([x for s in spans for x in (zeros[: -len(s) % _BLOCK], s)]), np.uint8)
    # The checksum starts with all bits set, which is the same as turning the first four bytes around.
    for k in range(4):
        padded[into + k] ^= 0xFF
    table, state = _step_table(), np.zeros(len(padded) // _BLOCK, np.uint32)
    for pair in np.ascontiguousarray(padded.view("<u2").reshape(-1, _BLOCK // 2).T):
        state = (state >> 16) ^ table[(state ^ pair) & 0xFFFF]
    out, tables = state[first], _block_tables()
    several = np.flatnonzero(blocks > 1)
    at = 1
    while len(several):
        old = out[several]
        out[several] = np.bitwise_xor.reduce([t[(old >> np.uint32(8 * k)) & 0xFF] for k, t in enumerate(tables)]) ^ state[first[several] + at]
        at += 1
        several = several[blocks[several] > at]
    return out ^ np.uint32(0xFFFFFFFF)


def _sealed(spans: list[bytes]) -> list[bytes]:
    """The masked checksums as they are written."""
    raw = masked(checksums(spans)).astype("<u4").tobytes() if spans else b""
    return [raw[k : k + 4] for k in range(0, len(raw), 4)]


def masked(checksum: np.ndarray) -> np.ndarray:
    return (checksum >> np.uint32(15) | checksum << np.uint32(17)) + np.uint32(MASK)


def framed(records: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records in frames, one after the other, and where each frame ends."""
    heads = [len(r).to_bytes(8, "little") for r in records]
    data = b"".join([x for parts in zip(heads, _sealed(heads), records, _sealed(records)) for x in parts])
    return data, np.cumsum([len(r) + HEAD + TAIL for r in records], dtype=np.int64)


class BadRecord(ValueError):
    """A frame whose length or checksum isn't what it says."""


def frame_ends(data: bytes) -> np.ndarray:
    """Where whole frames at the start of ``data`` end, by their lengths."""
    ends, at = [], 0
    while at + HEAD <= len(data):
        at += HEAD + TAIL + int.from_bytes(data[at : at + 8], "little")
        if at > len(data):
            break
        ends.append(at)
    return np.array(ends, np.int64)


def unframed(data: bytes, ends: np.ndarray) -> list[bytes]:
    """The records of whole frames, checked."""
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    heads, records = [data[s : s + 8] for s, _ in spans], [data[s + HEAD : e - TAIL] for s, e in spans]
    if any(len(r) < 4 or h != len(r).to_bytes(8, "little") for h, r in zip(heads, records)):
        raise BadRecord("a record has another length than the index says")
    if _sealed(heads) != [data[s + 8 : s + HEAD] for s, _ in spans] or _sealed(records) != [data[e - TAIL : e] for _, e in spans]:
        raise BadRecord("a record or its length doesn't fit its checksum")
    return records


class Encoder:
    """Texts as bytes of ids; distinct words are encoded once and kept, until there are too many.

    Words are looked up by a hash in a sorted array; a second hash tells words of one hash apart.  The few texts with such a
    word, with characters that the cutter doesn't know or with the text of an added token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.path = path
        self.width = id_bytes(path)
        self.type = f"<u{self.width}"
        self.array = {2: "H", 4: "I"}[self.width]
        self.added = [t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values()]
        self.shown = {b: c for c, b in byte_of().items()}
        self._forget()

    def _forget(self) -> None:
        self.known, self.check, self.slot, self.coded = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def _as_bytes(self, ids: list[int]) -> bytes:
        packed = array(self.array, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, by the tokenizer's own merges."""
        model, shown = tokenizer(self.path).model, self.shown
        return [self._as_bytes([t.id for t in model.tokenize(w.decode("latin-1").translate(shown))]) for w in words]

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in ``coded``, and which words have another word's hash."""
        first, second = span_hashes(data, starts, ends)
        distinct, place, which = np.unique(first, return_index=True, return_inverse=True)
        odd = second[place][which] != second
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        fresh = np.flatnonzero(~hit)
        slots = np.empty(len(distinct), np.int64)
        slots[hit] = self.slot[at[hit]]
        slots[fresh] = len(self.coded) + np.arange(len(fresh))
        odd |= (hit & (self.check[np.minimum(at, len(self.check) - 1)] != second[place]))[which] if len(self.check) else False
        self.coded += self._of_words([raw[s:e] for s, e in zip(starts[place[fresh]].tolist(), ends[place[fresh]].tolist())])
        self.known = np.insert(self.known, at[fresh], distinct[fresh])
        self.check = np.insert(self.check, at[fresh], second[place[fresh]])
        self.slot = np.insert(self.slot, at[fresh], slots[fresh])
        return slots[which], odd

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of flat texts, ``width`` bytes each."""
        if len(self.coded) > WORDS_KEPT:
            self._forget()
        starts, odd = cut_texts(data, offsets)
        raw = data.tobytes()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(content, at + 1)
        numbers, alike = self._numbers(raw, starts, np.append(starts[1:], len(data)), data)
        odd[np.searchsorted(offsets, starts[alike], "right") - 1] = True
        bounds = np.searchsorted(starts, offsets).tolist()
        coded, numbers = self.coded, numbers.tolist()
        return [self._as_bytes(tokenizer(self.path).encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids) if odd[k]
                else b"".join([coded[n] for n in numbers[bounds[k] : bounds[k + 1]]]) for k in range(len(odd))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder stays for the tasks that follow."""
    return Encoder(path)


def _named(name: int | None, width: int) -> bytes:
    return (name or 0).to_bytes(8, "little", signed=True) + int(name is not None).to_bytes(2, "little") + width.to_bytes(2, "little")


def _contents(record: bytes) -> tuple[int | None, np.ndarray]:
    """A record's doc_id and ids."""
    name = int.from_bytes(record[:8], "little", signed=True) if record[8] else None
    return name, np.frombuffer(record, f"<u{record[10]}", offset=NAME)


_INDEX = "file string, offset long, bytes long, n_tokens long, doc_id long"
_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.int64())])


def _write(folder: str, path: str, end_id: int, file_bytes: int, chunk: int):
    """Encode a partition's texts and write them; gives the index's rows.

    A second attempt of a task writes files of other names.  Only those of the attempt that ended well get into the index.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        part, attempt, coder = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], encoder(path)
        width, end = coder.width, end_id.to_bytes(coder.width, "little")
        pending, names, out, file, at, n_files = [], [], None, "", 0, 0

        def flush():
            nonlocal out, file, at, n_files, pending, names
            if out is None:
                file, at = f"part-{part:06d}-{n_files:04d}-{attempt}.records", 0
                out, n_files = system.open_output_stream(f"{top}/{file}"), n_files + 1
            data, ends = framed(pending)
            out.write(data)
            sizes = np.diff(ends, prepend=0)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([file] * len(ends)), pa.array(at + ends - sizes), pa.array(sizes), pa.array((sizes - HEAD - TAIL - NAME) // width), pa.array(names, pa.int64())], schema=_INDEX_ARROW)
            at += len(data)
            pending, names = [], []
            if at >= file_bytes:
                out.close()
                out = None
            return rows

        size = 0
        for batch in batches:
            for first, data, offsets in flat_texts(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(offsets) - 1).to_pylist()
                for name, tokens in zip(ids, coder.encode(data, offsets)):
                    pending.append(_named(name, width) + tokens + end)
                    names.append(name)
                    size += len(pending[-1])
                    if size >= chunk:
                        yield flush()
                        size = 0
        if pending:
            yield flush()
        if out is not None:
            out.close()

    return write


def _remove_other_files(spark: SparkSession, folder: str, files: DataFrame) -> None:
    """Delete record files that the index doesn't name: those of failed attempts.  There are a few for each task at most."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    known = {r["file"] for r in files.distinct().collect()}
    for status in system.listStatus(top) if system.exists(top) else []:
        name = status.getPath().getName()
        if name.endswith(".records") and name not in known:
            system.delete(status.getPath(), False)


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = 0, file_bytes: int = 1 << 28) -> DataFrame:
    """Write every text's ids (by the tokenizer at ``path``, without added special tokens, then ``end_id``) as a record, in ascending
    order of doc_id over the files in order of their names; returns the index, which is stored as ``folder``/index.

    The index (file, offset, bytes, n_tokens, doc_id) has one row for each record.  Texts are dealt into ranges of doc_id, then of a hash
    of the text, so many rows of one id don't meet in one task; a task writes files of about ``file_bytes`` and holds one chunk of
    them.  ``folder`` must be shared by all machines and known to pyarrow's file systems (a local or mounted path, HDFS, S3, GCS).

    Null and empty texts have a record of the end id alone.  Rows without doc_id come last.  Rows of one id stand next to each other, by
    their texts' hash; each has a record.  Other columns are ignored.  No rows give an empty index and no files.
    """
    spark = prepare(docs.sparkSession)
    system, top = fs.FileSystem.from_uri(folder)
    system.create_dir(top, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "m"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    index = dealt.select("doc_id", "text").mapInArrow(_write(folder, path, end_id, file_bytes, CHUNK), _INDEX)
    index.write.parquet(f"{folder}/index")
    index = read_index(spark, folder)
    _remove_other_files(spark, folder, index.select("file"))
    return index


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _read(folder: str, chunk: int):
    """Read the records that index rows name; neighbours in a file are read together."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, sizes = batch.column("file").to_pylist(), batch.column("offset").to_numpy(), batch.column("bytes").to_numpy()
            first = 0
            while first < len(files):
                last = first + 1
                while last < len(files) and files[last] == files[first] and offsets[last] == offsets[last - 1] + sizes[last - 1] and \
                        offsets[last] + sizes[last] - offsets[first] <= chunk:
                    last += 1
                if files[first] != name:
                    if source is not None:
                        source.close()
                    name, source = files[first], system.open_input_file(f"{top}/{files[first]}")
                source.seek(int(offsets[first]))
                data = source.read(int(sizes[first:last].sum()))
                records = unframed(data, np.cumsum(sizes[first:last]))
                names, ids = zip(*map(_contents, records))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files[first:last]), pa.array(offsets[first:last]), pa.array(names, pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())],
                    ["file", "offset", "doc_id", "tokens"])
                first = last
        if source is not None:
            source.close()

    return read


def read_records(index: DataFrame, folder: str, seed: int | None = None) -> DataFrame:
    """(file, offset, doc_id, tokens) of every record that ``index`` names, checked; tokens are little-endian unsigned 32-bit ids.

    Without ``seed`` records are read in stored order, a range of them in a task.  With it they come in a random order that the seed fixes, dealt to
    tasks by the same order, and each is read by its offset.
    """
    order = ["file", "offset"] if seed is None else ["shuffle", "file", "offset"]
    # The rows of the index are small: what tasks read decides how many there are.
    tasks = -(-(index.agg(F.sum("bytes")).first()[0] or 1) // READ)
    keyed = index if seed is None else index.withColumn("shuffle", F.xxhash64(F.lit(seed), "file", "offset"))
    dealt = keyed.select(*order, "bytes").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("file", "offset", "bytes").mapInArrow(_read(folder, CHUNK), "file string, offset long, doc_id long, tokens binary")


def with_ids(records: DataFrame) -> DataFrame:
    """``records`` with ``ids`` (array of int) in place of ``tokens``."""
    others = [c for c in records.columns if c != "tokens"]
    rows = records.select(F.struct(*others).alias("row"), "tokens")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t, "<u4").astype(np.int32) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int32()))], ["row", "ids"])

    return rows.mapInArrow(convert, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>").select("row.*", "ids")


def rebuilt_index(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """The index rows of ``files``, read from their frames alone, one file in a task at a time."""
    chunk = CHUNK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        for file in (f for batch in batches for f in batch.column("file").to_pylist()):
            with system.open_input_stream(f"{top}/{file}") as source:
                left, at = b"", 0
                while True:
                    more = source.read(chunk)
                    left += more
                    ends = frame_ends(left)
                    if len(ends):
                        records, sizes = unframed(left[: ends[-1]], ends), np.diff(ends, prepend=0)
                        names, ids = zip(*map(_contents, records))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file] * len(ends)), pa.array(at + ends - sizes), pa.array(sizes), pa.array([len(i) for i in ids], pa.int64()), pa.array(names, pa.int64())],
                            schema=_INDEX_ARROW)
                        left, at = left[ends[-1] :], at + int(ends[-1])
                    if not more:
                        break
                if left:
                    raise BadRecord(f"{file} ends inside a record")

    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)), "file")
    return named.mapInArrow(scan, _INDEX)


def token_positions(records: DataFrame) -> DataFrame:
    """``records`` (file, offset, n_tokens and more; read twice) with start: the ids of all records before, in stored order.

    A file's records are summed in one task, which file_bytes bounds; of the files there is one row each.
    """
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    files = records.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select(F.col("file").alias("of"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    inside = records.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(before, F.col("file") == F.col("of")).withColumn("start", F.col("base") + F.col("inside")).drop("of", "base", "inside")
