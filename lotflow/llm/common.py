"""What the operators share: stored tables, words, and texts as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.session import shared_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive execution splits the hot partitions of joins; Arrow batches stay small for very long texts."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, purpose: str, compression: str = "zstd", **options) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives the loss of any executor."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", compression).options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def hash_sample(rows: DataFrame, sample: int, *columns: str, room: int = 4) -> DataFrame:
    """At most ``sample`` rows, the first in the order of a hash of ``columns``.

    Of many rows only a share of ``room`` times the sample is sorted at all, so what meets in one task doesn't grow with
    the number of rows or tasks.
    """
    order = F.xxhash64(*columns)
    share = room * sample / max(1, rows.count())
    few = rows if share >= 1 else rows.filter(F.pmod(order, F.lit(1 << 31)) < int(share * (1 << 31)))
    return few.orderBy(order, *columns).limit(sample)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no result reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)


def flat_texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, bytes, offsets): at most ``most`` bytes in a run unless one text is longer.

    A null text is empty.
    """
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over 64 output bits (uint64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_BASE = int(constants(1, 12)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased), and the number of words before each text.

    A word's hash is the difference of two prefix sums of ``code[byte] * base ** position``, taken back to position 0.
    """
    starts, ends, before = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    with np.errstate(over="ignore"):
        terms = _BYTE[_LOWER[data]] * power(_BASE, len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        hashes = (sums[ends] - sums[starts]) * power(_INVERSE, len(data))[starts]
        return mixed(hashes), before


def arrow_longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
