"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import prepare, stored


def _line_key(line: Column) -> Column:
    """128 bits stand for a line."""
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, site: str, ratio: float, least: int) -> DataFrame:
    """(site, line key) of the lines on more than ``ratio`` of their site's pages, and on ``least`` pages at least."""
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    pages = lines.filter(F.trim("line") != "").groupBy("site", _line_key(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("pages"))
    totals = docs.groupBy(F.col(site).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("total"))
    frequent = pages.filter(F.col("pages") >= least).join(totals, F.col("site").eqNullSafe(F.col("s")))
    return frequent.filter(F.col("pages") > F.col("total") * ratio).select("site", "line")


def without_boilerplate(docs: DataFrame, site: str = "source", ratio: float = 0.05, least: int = 4) -> DataFrame:
    """The documents, all columns, with their sites' boilerplate lines cut from ``text``, and ``n_lines`` and
    ``n_dropped``.

    Pages of a site are the rows with the same ``site`` (null is a site).  A line (between line feeds, as it is) is
    boilerplate if more than ``ratio`` of the site's pages hold it, ``least`` pages at least; a page counts once however
    often it repeats the line.  Blank lines (of spaces) are never cut.  Counts are combined before the shuffle, and
    only 128-bit keys of lines are shuffled; texts move once, by row.

    A null text stays null, with no lines; an empty one has one line, which is blank; a text that loses all its lines
    becomes empty.  Columns named n_lines or n_dropped are replaced.  Repeated rows are pages of their own, and equal rows lose the same lines.  No rows give no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    drop = stored(boilerplate(docs, site, ratio, least), "boilerplate")
    row = [F.col("doc_id").alias("__cut_id"), F.xxhash64("text", F.lit(1)).alias("__cut_text"), F.xxhash64("text", F.lit(2)).alias("__cut_again")]
    key = ["__cut_id", "__cut_text", "__cut_again"]
    lines = docs.select(*row, F.col(site).cast("string").alias("__cut_site"), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    hits = lines.select(*key, "__cut_site", _line_key(F.col("line")).alias("__cut_line")).join(
        drop, F.col("__cut_site").eqNullSafe(F.col("site")) & (F.col("__cut_line") == F.col("line")))
    cut = hits.groupBy(*key, "__cut_site").agg(F.collect_set("__cut_line").alias("__cut_cut"))
    cut = cut.select(*[F.col(k).alias(f"right{k}") for k in key], F.col("__cut_site").alias("right_site"), "__cut_cut")
    rows = docs.select("*", *row)
    on = F.col("__cut_site").eqNullSafe(F.col("right_site"))
    rows = rows.withColumn("__cut_site", F.col(site).cast("string"))
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"right{k}"))
    rows = rows.join(cut, on, "left").withColumn("__cut_lines", F.split("text", "\n", -1))
    stay = F.filter("__cut_lines", lambda line: ~F.array_contains("__cut_cut", F.unhex(F.md5(line))))
    kept = F.when(F.col("__cut_cut").isNull(), F.col("__cut_lines")).otherwise(stay)
    rows = rows.withColumn("__cut_kept", kept)
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    text = F.when(F.col("__cut_cut").isNull(), F.col("text")).otherwise(F.array_join("__cut_kept", "\n"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], n("__cut_lines").alias("n_lines"),
                       (n("__cut_lines") - n("__cut_kept")).alias("n_dropped"))
