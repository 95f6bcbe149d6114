"""Byte-level BPE by a table of distinct words, and decoding through a join of ids with their pieces."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import constants, flat_texts, mixed, power, prepare, stored

#: Fixed value: how byte-level BPE of this family cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
#: Ranges whose letters and digits are the same in every version of Unicode that matters here; texts with other
#: characters are cut by the tokenizer itself.
STABLE = [(0x0000, 0x052F), (0x2000, 0x2064), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x2500, 0x27BF), (0x3041, 0x3096), (0x30A1, 0x30FA),
          (0x4E00, 0x9FEF), (0xAC00, 0xD7A3)]
#: Characters of a batch, which shares one dictionary; a longer text is a batch of its own.
BATCH_CHARS = 16_000_000
SPACE, WHITE, LETTER, DIGIT, OTHER, UNKNOWN = range(6)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def _added(path: str) -> list[str]:
    """The vocabulary's added tokens, longest first: they are cut out of a text before anything else."""
    return sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def words_of(text: str, path: str) -> Iterator[str]:
    """The words of a text in order; joined, they are the text."""
    added, at = _added(path), 0
    if added:
        for hit in regex.finditer("|".join(map(regex.escape, added)), text):
            yield from _plain_words(text[at : hit.start()], path)
            yield hit[0]
            at = hit.end()
    yield from _plain_words(text[at:] if at else text, path)


def _plain_words(text: str, path: str) -> Iterator[str]:
    return (text[s:e] for _, (s, e) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point below 0x10000."""
    table = np.full(0x10000, UNKNOWN, np.uint8)
    for first, last in STABLE:
        for code in range(first, last + 1):
            c = chr(code)
            table[code] = SPACE if c == " " else WHITE if regex.match(r"\s", c) else (
                LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER)
    return table


def cut_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of flat texts start, and which texts hold characters that this function does not know.

    The pattern as rules on runs of one class: a run of letters, digits or other signs is a word and takes one space
    before it along; of other white space before a word, the last character is a word of its own and so is what comes
    before; white space at the end is one word.  A sign of contraction right after a word takes its letters along.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    follow = np.concatenate((data, np.zeros(3, np.uint8)))
    two, three = np.flatnonzero((code >= 0xC0) & (code < 0xE0)), np.flatnonzero((code >= 0xE0) & (code < 0xF0))
    four = code >= 0xF0
    code[two] = (code[two] & 0x1F) << 6 | (follow[at[two] + 1] & 0x3F)
    code[three] = (code[three] & 0x0F) << 12 | (follow[at[three] + 1].astype(np.int32) & 0x3F) << 6 | (follow[at[three] + 2] & 0x3F)
    kind = _classes()[np.where(four, 0, code)]
    kind[four] = UNKNOWN
    text = np.searchsorted(offsets, at, "right") - 1
    odd = np.zeros(len(offsets) - 1, bool)
    odd[text[kind == UNKNOWN]] = True
    white = kind <= WHITE
    run = np.where(white, SPACE, kind)
    first = np.ones(len(at), bool)
    first[1:] = text[1:] != text[:-1]
    begins = first.copy()
    begins[1:] |= run[1:] != run[:-1]
    # The last white character before a word begins a word: with what follows if it is a space, else alone.
    before = np.flatnonzero(~white[1:] & white[:-1] & ~first[1:])
    begins[before] = True
    begins[before + 1] = kind[before] != SPACE
    # Contractions: a single apostrophe that begins a word, with the letters that follow.
    mark = np.flatnonzero(begins & (code == ord("'")))
    mark = mark[mark + 1 < len(at)]
    mark = mark[~first[mark + 1]]
    code = np.concatenate((code, np.zeros(2, np.int32)))
    one, more = code[mark + 1], code[mark + 2]
    inside = np.concatenate((~first, [False, False]))[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & inside & np.logical_or.reduce([(one == ord(a)) & (more == ord(b)) for a, b in ("re", "ve", "ll")])
    begins = np.concatenate((begins, np.ones(2, bool)))
    for hit, size in ((mark[short], 2), (mark[long], 3)):
        begins[hit + 1] = False
        if size == 3:
            begins[hit + 2] = False
        begins[hit + size] |= True
    return at[np.flatnonzero(begins[: len(at)])], odd


_BYTES = constants(256, 41), constants(256, 42)
_BASES = [int(c) for c in constants(2, 43)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte spans, by differences of prefix sums."""
    out = []
    with np.errstate(over="ignore"):
        for code, base in zip(_BYTES, _BASES):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code[data] * power(base, len(data)), dtype=np.uint64)))
            out.append(mixed((sums[ends] - sums[starts]) * power(pow(base, -1, 1 << 64), len(data))[starts]))
    return out[0], out[1]


class _Dictionary:
    """The words of one batch, numbered in order of first use."""

    def __init__(self):
        self.numbers: dict[int | tuple[int, int], int] = {}
        self.words: list[bytes] = []
        self.checks = np.zeros(0, np.uint64)

    def number(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """The numbers of distinct words, given by their hashes and where they are in ``raw``."""
        known, words, out = self.numbers, self.words, []
        for h, s, e in zip(first.tolist(), starts.tolist(), ends.tolist()):
            n = known.get(h)
            if n is None:
                n = known[h] = len(words)
                words.append(raw[s:e])
            out.append(n)
        numbers = np.array(out, np.int64)
        if len(self.checks) < len(words):
            self.checks = np.concatenate((self.checks, np.zeros(max(1024, len(words)), np.uint64)))
        fresh = self.checks[numbers] == 0
        self.checks[numbers[fresh]] = second[fresh] | np.uint64(1)
        for k in np.flatnonzero(self.checks[numbers] != second | np.uint64(1)).tolist():
            # Another word has this word's first hash: this one goes by both.
            key = int(first[k]), int(second[k])
            if key not in known:
                known[key] = len(words)
                words.append(raw[starts[k] : ends[k]])
            numbers[k] = known[key]
        return numbers.astype(np.uint32)

    def of_texts(self, data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
        """Each text as numbers of words."""
        starts, odd = cut_texts(data, offsets)
        raw = data.tobytes()
        for content in _added(path):
            at = raw.find(content.encode())
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(content.encode(), at + 1)
        ends = np.append(starts[1:], len(data))
        last = np.searchsorted(starts, offsets[1:])
        first = np.searchsorted(starts, offsets[:-1])
        h1, h2 = span_hashes(data, starts, ends)
        distinct, place, which = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[place][which] != h2).any():
            odd[:] = True
        known = self.number(distinct, h2[place], starts[place], ends[place], raw)[which]
        return [self._slowly(raw[offsets[i] : offsets[i + 1]].decode(), path) if odd[i] else known[first[i] : last[i]]
                for i in range(len(odd))]

    def _slowly(self, text: str, path: str) -> np.ndarray:
        words = [w.encode() for w in words_of(text, path)]
        raw = b"".join(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate((ends[:0], [0], ends))[: len(words)].astype(np.int64)
        return self.number(*span_hashes(np.frombuffer(raw, np.uint8), starts, ends), starts, ends, raw)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, so that the mostly empty high bytes vanish."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 5)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _batches(batches: Iterator[pa.RecordBatch], path: str):
    """(name, ids, texts as numbers by falling frequency, words in that order) of each batch of texts.

    A batch is a run of a partition's rows, so the same input gives the same batches.
    """
    part, n, size, ids, texts, words = TaskContext.get().partitionId(), 0, 0, [], [], _Dictionary()

    def done():
        used = np.bincount(np.concatenate(texts), minlength=len(words.words)) if words.words else np.zeros(0, np.int64)
        order = np.argsort(-used, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return part << 32 | n, ids, [rank[t] for t in texts], [words.words[k] for k in order.tolist()]

    for batch in batches:
        for first, data, offsets in flat_texts(batch.column("text")):
            if size and size + len(data) > BATCH_CHARS:
                yield done()
                n, size, ids, texts, words = n + 1, 0, [], [], _Dictionary()
            size += len(data) + 1
            ids += batch.column("doc_id").slice(first, len(offsets) - 1).to_pylist()
            texts += words.of_texts(data, offsets, path)
    if ids:
        yield done()


def _check(words: list[bytes]) -> int:
    """Stands for a dictionary: both passes over the texts must have found the same."""
    total = 0
    for word in words:
        total = zlib.crc32(word, total)
    return total << 20 | min(len(words), (1 << 20) - 1)


def _dictionaries(path: str, buckets: int):
    """Each batch's words, dealt to buckets by their hash: the numbers and the words of a bucket in one row."""
    def deal(batches):
        for name, _, _, words in _batches(batches, path):
            check = _check(words)
            bucket = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                own = order[bounds[b] : bounds[b + 1]]
                if len(own):
                    listed = [words[k] for k in own.tolist()]
                    rows.append({"batch": name, "check": check, "bucket": b, "numbers": _packed(np.diff(own, prepend=0)),
                                 "lengths": _packed(np.array([len(w) for w in listed])), "words": zlib.compress(b"".join(listed), 5)})
            yield pa.RecordBatch.from_pylist(rows, _LISTED)

    return deal


_LISTED = pa.schema([("batch", pa.int64()), ("check", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
_CODED = "batch long, check long, numbers binary, lengths binary, ids binary, used array<int>"


def _encode_bucket(path: str):
    """Encode each distinct word of a bucket once, and give every batch the ids of its words."""
    def encode(rows: pa.Table) -> pa.Table:
        listed, distinct = [], {}
        for lengths, words in zip(rows.column("lengths").to_pylist(), rows.column("words").to_pylist()):
            ends = np.cumsum(_unpacked(lengths)).tolist()
            flat = zlib.decompress(words)
            listed.append([distinct.setdefault(flat[s:e], len(distinct)) for s, e in zip([0, *ends], ends)])
        texts = [w.decode() for w in distinct]
        ids = []
        for s in range(0, len(texts), 10_000):
            ids += [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch(texts[s : s + 10_000], add_special_tokens=False)]
        lengths, flat, used = [], [], []
        for places in listed:
            found = [ids[k] for k in places]
            every = np.concatenate(found)
            lengths.append(_packed(np.array([len(f) for f in found])))
            flat.append(_packed(every))
            used.append(np.unique(every).astype(np.int32))
        return pa.table({"batch": rows.column("batch"), "check": rows.column("check"), "numbers": rows.column("numbers"), "lengths": pa.array(lengths, pa.binary()),
                         "ids": pa.array(flat, pa.binary()), "used": pa.array(used, pa.list_(pa.int32()))})

    return encode


def _positions(path: str):
    """Each text as the numbers of its words, with what its batch's dictionary must be."""
    schema = pa.schema([("batch", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("positions", pa.binary())])

    def place(batches):
        for name, ids, texts, words in _batches(batches, path):
            check = _check(words)
            for s in range(0, len(ids), 1000):
                some = ids[s : s + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some)), pa.array([check] * len(some)), pa.array(some, pa.int64()),
                     pa.array([_packed(t) for t in texts[s : s + 1000]], pa.binary())], schema=schema)

    return place


def _whole_batch(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """The texts of one batch: ids by position, and their pieces by id."""
    ids_of: dict[int, np.ndarray] = {}
    pieces: dict[int, bytes] = {}
    # Texts without a word have an empty dictionary, of which there is no part.
    checks = set(docs.column("check").to_pylist()) - {0}
    for row in parts.to_pylist():
        if row["piece"] is not None:
            pieces[row["id"]] = bytes.fromhex(row["piece"])
            continue
        checks.add(row["check"])
        ends = np.cumsum(_unpacked(row["lengths"]))
        for number, ids in zip(np.cumsum(_unpacked(row["numbers"])).tolist(), np.split(_unpacked(row["ids"]), ends[:-1])):
            ids_of[number] = ids
    found = [ids_of[k] for k in range(len(ids_of))]
    spelled = [b"".join([pieces[i] for i in ids.tolist()]) for ids in found]
    lengths = np.array([len(f) for f in found], np.int64)
    starts, flat = np.cumsum(lengths) - lengths, np.concatenate([*found, np.zeros(0, np.uint32)])
    coded, texts = [], []
    if len(checks) > 1:
        raise RuntimeError("the texts changed between two readings: store them first")
    for blob in docs.column("positions").to_pylist():
        at = _unpacked(blob).astype(np.int64)
        n = lengths[at]
        coded.append(flat[np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)].astype(np.int32))
        texts.append(b"".join(map(spelled.__getitem__, at.tolist())).decode("utf-8", "replace"))
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int32)
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(coded))),
                     "decoded": pa.array(texts, pa.string())})


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable Latin-1 characters for themselves, the
    other bytes in order for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces(spark, path: str) -> DataFrame:
    """(id, piece): the bytes of every id of the vocabulary, in hexadecimal digits; a task reads the vocabulary, not the driver."""
    def spell(_):
        loaded, code = tokenizer(path), byte_of()
        added = {t.content for t in loaded.get_added_tokens_decoder().values()}
        ids, words = [], []
        for w, i in loaded.get_vocab().items():
            ids.append(i)
            words.append((w.encode() if w in added else bytes(code[c] for c in w)).hex())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(words, pa.string())], names=["id", "piece"])

    return spark.range(0, 1, 1, 1).mapInArrow(spell, "id int, piece string")


def _joined_pieces(entry: Column) -> Column:
    """The bytes of collected (place, piece) entries."""
    return F.unhex(F.array_join(F.transform(F.array_sort(entry), lambda e: e["piece"]), ""))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, ids (as the tokenizer at ``path`` encodes the text, without added special tokens;
    their strings in a text are those tokens) and decoded (the text of these ids).

    Texts are cut into words in batches of BATCH_CHARS characters, runs of rows of a partition; a batch numbers its
    words.  The batches' dictionaries, not the texts, are shuffled by word, packed by bucket of the word's hash: a
    bucket's table of distinct words is encoded, each word once, and the ids go back to the batches.  The ids that a
    batch uses get their pieces by a join with the vocabulary.  A text travels as the numbers of its words, and ids and
    pieces are joined to it by position.  A frequent word is in every batch once, so no word is hot.

    The texts are read twice and must be the same both times, as those of stored tables are; if they aren't, the job
    fails.  Null and empty texts have no ids and decode to an empty text.  Rows are never told apart by doc_id, so null and
    repeated ids do no harm.  No rows give no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    # Few words of a batch in a bucket would make as many entries of ids in use as words.
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = source.mapInArrow(_dictionaries(path, buckets), "batch long, check long, bucket int, numbers binary, lengths binary, words binary")
    coded = stored(listed.groupBy("bucket").applyInArrow(_encode_bucket(path), _CODED), "bpe-codes", "none")
    used = coded.select("batch", F.explode("used").alias("id")).distinct()
    # The vocabulary is a fixed table of some 50,000 short pieces.
    spelled = used.join(F.broadcast(pieces(spark, path)), "id")
    none = F.lit(None).cast("binary")
    parts = coded.select(F.col("batch").alias("of"), "check", "numbers", "lengths", "ids", F.lit(None).cast("int").alias("id"),
                         F.lit(None).cast("string").alias("piece")).unionAll(
        spelled.select("batch", F.lit(None).cast("long"), none, none, none, "id", "piece"))
    texts = source.mapInArrow(_positions(path), "batch long, check long, doc_id long, positions binary")
    return texts.groupBy("batch").cogroup(parts.groupBy("of")).applyInArrow(_whole_batch, "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text; see ``encode_decode``."""
    return encode_decode(docs, path).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every row of ``encoded(doc_id, ids)``: each id joined with its piece, in order.

    No ids give an empty text, and ids outside the vocabulary add nothing.  Bytes that aren't whole characters, as where ids end
    inside one, become U+FFFD, as the tokenizer has them.
    """
    spark = encoded.sparkSession
    row = F.monotonically_increasing_id()
    rows = stored(encoded.select(row.alias("row"), "doc_id", "ids"), "bpe-ids")
    each = rows.select("row", F.posexplode("ids").alias("place", "id")).join(F.broadcast(pieces(spark, path)), "id")
    spelled = each.groupBy("row").agg(_joined_pieces(F.collect_list(F.struct("place", "piece"))).alias("bytes"))
    text = F.coalesce(F.make_valid_utf8(F.col("bytes").cast("string")), F.lit(""))
    return rows.select("row", "doc_id").join(spelled, "row", "left").select("doc_id", text.alias("decoded"))
