"""Near-duplicate documents by MinHash with tensored banding, every candidate confirmed on its full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import arrow_longs, constants, discard, flat_texts, mixed, prepare, stored, word_hashes
from lotflow.llm.graph import components


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a text of fewer words has one of all its words."""
    words, before = word_hashes(data, offsets)
    factor = constants(width + 1, 21)
    with np.errstate(over="ignore"):
        rows = max(0, len(words) - width + 1)
        rolled = np.zeros(rows, np.uint64)
        for k in range(width):
            rolled = rolled * factor[0] + mixed(words[k : k + rows] + factor[k + 1])
        rolled = mixed(rolled)
        out = []
        for first, last in zip(before[:-1], before[1:]):
            if last - first >= width:
                out.append(np.unique(rolled[first : last - width + 1]))
            elif last > first:
                short = reduce(lambda h, w: mixed(h * factor[0] + w), words[first:last], factor[1:2] + np.uint64(last - first))
                out.append(np.asarray(short).reshape(-1)[:1])
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _signer(width: int, rows: int, collections: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set size, 128-bit set digest and both sides' band hashes of each text."""
    factors = constants(2 * rows * collections, 31)
    shifts = constants(2 * rows * collections, 32)
    fold = constants(rows, 33)

    def sign(batches):
        for batch in batches:
            for first, data, offsets in flat_texts(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(sizes)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
                digest = np.zeros((2, len(sets)), np.uint64)
                bands = np.zeros((len(sets), 2 * collections), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        for k, salt in enumerate(constants(2, 34)):
                            digest[k, full] = np.add.reduceat(mixed(every ^ salt), starts)
                        for c in range(2 * collections):
                            band = np.zeros(len(full), np.uint64)
                            for r in range(rows):
                                h = c * rows + r
                                low = np.minimum.reduceat((every ^ shifts[h]) * factors[h], starts)
                                band = mixed(band + low * fold[r])
                            bands[full, c] = band
                ids = batch.column("doc_id").slice(first, len(sets))
                sides = [
                    pa.ListArray.from_arrays(np.arange(0, len(sets) * collections + 1, collections, dtype=np.int32),
                                             arrow_longs(np.ascontiguousarray(side).reshape(-1)))
                    for side in (bands[:, :collections], bands[:, collections:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), arrow_longs(digest[0]), arrow_longs(digest[1]), *sides],
                    names=["doc_id", "n_shingles", "d1", "d2", "left", "right"])

    return sign


def _setter(width: int):
    def sets(batches):
        for batch in batches:
            for first, data, offsets in flat_texts(batch.column("text")):
                found = shingle_sets(data, offsets, width)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(found)), pa.ListArray.from_arrays(bounds, arrow_longs(np.concatenate(found)))],
                    names=["id", "shingles"])

    return sets


def _sharing_rare(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of ``docs`` (id, n, component) of different components that may reach ``percent``: no other pair does.

    Each set's shingles are ordered from the rarest to the most frequent among ``docs``.  A set of n shingles that reaches the
    threshold with a set that isn't larger has one in common with it among its first n - ceil(p n) + 1, and that one is among the
    first m - ceil(2 p m / (1 + p)) + 1 of the other's m.  What stands before the first common one is lost to both, which the
    sizes of what is left must allow for.  Edits make a shingle rare, so copies with many edits don't get as far as what
    all copies share.
    """
    each = docs.join(sets, "id").select("id", "n", "component", F.explode("shingles").alias("shingle"))
    counts = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")), "shingle-counts")
    n = F.col("n")
    longer = n - F.expr(f"({percent} * n + 99) div 100") + 1
    shorter = n - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1
    # A shingle of one document is in no pair, but has its place in the order.
    ordered = each.join(counts, "shingle").groupBy("id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("docs", "shingle"))).alias("s"))
    rare = ordered.select("id", "n", "component", longer.alias("longer"), shorter.alias("shorter"), F.posexplode("s").alias("place", "s"))
    rare = stored(rare.filter("place < longer and s.docs > 1").select(
        "id", "n", "component", "place", F.col("s.shingle").alias("shingle"), (F.col("place") < F.col("shorter")).alias("early")), "rare-shingles")
    x, y = rare.alias("x"), rare.filter("early").alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") > F.col("y.id")))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & larger & (F.col("x.component") != F.col("y.component"))
                   & (100 * F.col("y.n") >= percent * F.col("x.n")) & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 3, collections: int = 12) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked if their sets of ``width``-word shingles (A-Z lower-cased) reach ``percent`` per cent of
    their union; a component is named by its smallest doc_id and only that row is kept.

    Tensored banding: each side has ``collections`` bands of ``rows`` minhashes, and every pair of a left and a right
    band is the key of one table.  2 * collections * rows minhashes fill collections ** 2 tables, each as selective as
    2 * rows minhashes.  With s the similarity, a pair is missed with a probability of about
    2 * (1 - s ** rows) ** collections: 3.6e-4 at 0.8 and 12 bands, 1.5e-4 at 0.85 and 10, falling fast above.

    Equal sets become one class first.  A group of n documents isn't compared pair by pair: in the tables of bands of
    equal places each document meets its group's first; in any table's group that is then in several components,
    each meets the first of the largest component; and only where a group is in several components even
    then, its documents meet those of other components that share a shingle so rare that similar sets must share one such
    (``_sharing_rare``).  So documents of one component need no further links, and none between two components is lost.
    Links are confirmed on the full sets (64-bit hashes).

    Null, empty and blank texts have no shingles: linked with nothing, kept.  Rows that share a doc_id count as one
    document.  A row without doc_id is a link's end for nobody; its component is that of equal sets, or null, and it
    is kept only if that is null.  No rows give no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(source.mapInArrow(
        _signer(width, rows, collections),
        "doc_id long, n_shingles long, d1 long, d2 long, left array<long>, right array<long>"), "minhash")
    same = ["n_shingles", "d1", "d2"]
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("id"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = stored(classes.filter("id is not null"), "classes")

    left = classes.select("id", "n_shingles", "right", F.posexplode("left").alias("i", "x"))
    keys = left.select("id", "n_shingles", "i", "x", F.posexplode("right").alias("j", "y"))
    # The lowest bit tells the tables of a left and a right band of the same place.
    key = F.xxhash64("i", "j", "x", "y")
    keys = keys.select((key - F.pmod(key, F.lit(2)) + (F.col("i") == F.col("j")).cast("long")).alias("key"), "id", F.col("n_shingles").alias("n"))
    groups = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    members = stored(keys.join(groups, "key"), "members")

    ids = members.select("id").distinct()
    sets = stored(source.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").select(F.col("id").alias("doc_id"), "text")
                  .mapInArrow(_setter(width), "id long, shingles array<long>"), "shingles")

    def compare(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with their similarity and whether it reaches the threshold."""
        one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
        two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
        rows = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("s", "t")))
        union = F.size("s") + F.size("t") - F.col("both")
        return rows.select("a", "b", (F.col("both") / union).alias("jaccard"), (100 * F.col("both") >= percent * union).alias("linked"))

    def as_links(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def named(found: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "key", "id", "n", F.coalesce("component", "id").alias("component"))

    # First the tables of equal places: each document with its group's first.
    some = members.filter("key % 2 <> 0 and id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    links = stored(compare(some).filter("linked").select("a", "b"), "links")
    found = components(links)

    # Then the groups of all tables that are still torn: each document with the first of the group's largest component.
    parts = named(found).groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    lead = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("lead"), F.count(F.lit(1)).alias("parts"))
    torn = stored(members.join(lead.filter("parts > 1"), "key").select("key", "id", "n", "lead"), "torn")
    checked = stored(compare(torn.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()), "checked")
    # What is known of the components stands for the links it came from.
    old, found = found, components(as_links(found).unionAll(checked.filter("linked").select("a", "b")))
    discard(old, links)

    # At last what is torn even now: pairs of different components that share one of their rarest shingles.
    rows = torn.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    still = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    open_ = stored(rows.join(still, "key").select("id", "n", "component").distinct(), "open")
    rest = stored(_sharing_rare(open_, sets, percent), "rest")
    more = stored(compare(rest).filter("linked").select("a", "b"), "more")
    if not more.isEmpty():
        old, found = found, components(as_links(found).unionAll(more))
        discard(old)
    named_class = classes.select(*same, "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        *same, F.coalesce("component", "id").alias("component"))
    named_class = stored(named_class, "components")
    out = signed.join(named_class, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    discard(members, sets, torn, checked, open_, rest, more, found, classes)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
