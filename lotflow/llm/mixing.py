"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotflow.llm.common import discard, n_words, prepare, stored


def targets(sizes: DataFrame, weight: Column, share: tuple[int, int], epochs: int) -> DataFrame:
    """``sizes(source, source_size)`` with each source's ``target``.

    share = (3, 2) asks for 150 per cent of all sizes.  The level of the water-filling is found in one pass: sources
    are clamped at ``epochs`` times their size in order of cap per weight, as long as the rest, shared by weight, is
    above the cap of the next one.  One row per source is all that meets here.
    """
    asked, parts = share
    cap = F.col("source_size") * epochs
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", F.row_number().over(by_source) - 1)
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    before_cap, before_weight = (F.coalesce(F.sum(c).over(filled), F.lit(0)) for c in ("cap", "weight"))
    rows = rows.withColumns({
        # What is left for this source and those after it, in 1 / parts of a word, and the weight it is shared by.
        "left": total * asked - before_cap * parts, "of": F.sum("weight").over(every) - before_weight})
    rows = rows.withColumn("clamped", F.col("left") * F.col("weight") >= F.col("cap") * parts * F.col("of"))
    free = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "place", "left", "of"))).over(every)
    rows = rows.withColumn("free", free)
    level = F.col("weight") * F.col("free.left") / (F.col("free.of") * parts)
    return rows.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(level).cast("double"))


#: Prefixes of the seeded order; a source's rows of one prefix are ordered together.
PREFIX = 3
#: All rows of a place.
ALL = 2**62


def _ranked(docs: DataFrame, seed: str) -> DataFrame:
    """The documents with their place in the seeded order; rows without doc_id are spread by their text."""
    text = F.xxhash64("text")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x1f"), text.cast("string")))
    rank = F.md5(F.concat_ws("\x1f", F.lit(seed), named))
    place = F.struct(rank.alias("rank"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), text.alias("text"))
    return docs.withColumn("_place", place)


def plan(sized: DataFrame, weight: Column | None, share: tuple[int, int], epochs: int) -> DataFrame:
    """One row per source: source, source_size, target, whole, ``until``, the last place taken once more, and ``copies``,
    how many of that place's rows are.

    ``sized(source, size, _place)``.  Equal rows are counted first, so they meet nowhere.  The prefix sums of the seeded
    order are taken in two steps: over the totals of the first PREFIX hex digits, then within the one prefix where the
    rest of the target is met.
    """
    if weight is None:
        weight = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("place") % 3 + 1).cast("int"))
    prefix = F.substring("_place.rank", 1, PREFIX)
    parts = stored(sized.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("part"), F.max("_place").alias("end")), "mix-parts")
    sources = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weight, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stored(sources.select("source", "source_size", "target", whole.alias("whole"),
                                    (F.col("target") - whole * F.col("source_size")).alias("rest")), "mix-sources")
    so_far = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    spots = parts.withColumn("before", F.coalesce(F.sum("part").over(so_far), F.lit(0)))
    spots = spots.join(sources.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passed = spots.filter(F.col("before") + F.col("part") <= F.col("rest")).select("source", "end", F.lit(ALL).alias("copies"))
    met = spots.filter((F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("part"))).select(
        F.col("source").alias("_s"), F.col("prefix").alias("_p"), "before", "rest")
    inside = sized.withColumn("prefix", prefix).join(met, F.col("source").eqNullSafe(F.col("_s")) & (F.col("prefix") == F.col("_p")))
    inside = inside.groupBy("source", "_place", "size", "before", "rest").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    # Of n rows of a place, as many as have at least half of themselves before the rest ends.
    half = F.col("rest") * 2 - (F.col("at") * 2 + F.col("size"))
    fit = F.when(half < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(
        F.least(F.col("n"), F.floor(half / F.greatest(F.col("size") * 2, F.lit(1))) + 1))
    fits = inside.withColumn("fit", fit.cast("long")).filter("fit > 0").select(
        "source", F.col("_place").alias("end"), F.when(F.col("fit") < F.col("n"), F.col("fit")).otherwise(F.lit(ALL)).alias("copies"))
    last = passed.unionAll(fits).groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("end", "copies")).alias("last"))
    last = last.select("_s", F.col("last.end").alias("until"), F.col("last.copies").alias("copies"))
    out = sources.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest")
    out = stored(out, "mix-plan")
    discard(parts, sources)
    return out


def _first_copies(rows: DataFrame) -> DataFrame:
    """Of each source's rows, all of one place, the first ``copies`` as they are stored.

    The rows of a task are counted, then numbered only in the one task where the number is met.
    """
    task = F.shiftright("_at", 33)
    counts = rows.groupBy("source", "copies", task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).filter("before < copies")
    counts = counts.select(F.col("source").alias("_s"), F.col("task").alias("_t"), "before", (F.col("before") + F.col("n") <= F.col("copies")).alias("all"))
    near = rows.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (task == F.col("_t")))
    number = F.row_number().over(Window.partitionBy("source", "_t").orderBy("_at"))
    some = near.filter("not all").withColumn("_number", number).filter("before + _number <= copies")
    return near.filter("all").select(*rows.columns).unionAll(some.select(*rows.columns))


def _times(rows: DataFrame, decided: DataFrame) -> DataFrame:
    named = decided.withColumnRenamed("source", "_source")
    more = F.coalesce(F.col("_place") <= F.col("until"), F.lit(False)).cast("long")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("times", F.col("whole") + more)
    if decided.filter(F.col("copies") < ALL).isEmpty():
        return out
    # Some of a place's equal rows are taken once more: these alone are numbered, in a stored table.
    cut = F.coalesce((F.col("_place") == F.col("until")) & (F.col("copies") < ALL), F.lit(False))
    equal = stored(out.filter(cut).withColumn("_at", F.monotonically_increasing_id()), "mix-equal-rows")
    taken = _first_copies(equal).select(F.col("_at").alias("_taken"))
    marked = equal.join(taken, F.col("_at") == F.col("_taken"), "left")
    marked = marked.withColumn("times", F.when(F.col("_taken").isNull(), F.col("whole")).otherwise(F.col("times")))
    return out.filter(~cut).unionByName(marked.drop("_at", "_taken"))


def mix(docs: DataFrame, weight: Column | None = None, share: tuple[int, int] = (3, 2), epochs: int = 2, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target (of its source), taken, times.

    ``weight`` is an expression over ``place``, the rank of the source by code point (null last, from 0); by default
    5, 2, 1, repeating.  The mix asks for ``share`` of all words, each source at most ``epochs`` times its size; what a
    clamped source can't take goes to the others by weight until all fit.

    Each row is taken whole as often as the target holds its source whole; of the rest, rows are taken once more in a
    seeded order (md5 of seed and doc_id, or of a hash of the text where that is null, then text) while at least half of a
    row still fits, so that a source misses its target by half a row at most.  Of rows equal in source, id and text, so
    many are taken once more as fit; which of them is open, as nothing here tells them apart.

    Null texts and texts without words have size 0; a null source is a source.  If the share is above ``epochs``,
    every source is clamped.  No rows give no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = stored(_ranked(rows, seed).withColumn("size", n_words(F.col("text"))).drop("text"), "mix-rows")
    out = _times(rows, plan(rows, weight, share, epochs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(docs: DataFrame, weight: Column | None = None, share: tuple[int, int] = (3, 2), epochs: int = 2,
                    seed: str = "mix") -> DataFrame:
    """The mix itself: every input row, all its columns, as often as it is taken (see ``mix``)."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = stored(_ranked(narrow, seed).withColumn("size", n_words(F.col("text"))).drop("text", "doc_id"), "mix-rows")
    decided = plan(rows, weight, share, epochs)
    discard(rows)
    # The row travels as one value, so that no column of it can clash.
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    out = _times(_ranked(whole, seed), decided).filter("times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
