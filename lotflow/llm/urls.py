"""URL filters by a range join: reversed hosts, sorted together with the rules, and a stack of nested rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import hash_sample, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above every key that begins with the same text.
LAST = chr(0x10FFFF)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels from the last to the first, each closed by a slash, which no host holds: the keys of a host's
    subdomains are those that begin with its own, an interval of the sorted keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _deal_pages(splits: list[tuple]):
    """Each page to the part of the sorted (key, path, salt) that it lies in."""
    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "salt")))
            part = pa.array([bisect_right(splits, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])

    return deal


def _deal_rules(splits: list[tuple]):
    """Each rule to every part that its interval of keys touches."""
    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                first, last = bisect_right(splits, (row["key"],)), bisect_right(splits, (row["key"] + LAST,))
                rows += [{"part": part, **row} for part in range(first, last + 1)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("part", pa.int32()), *batch.schema]))

    return deal


_ROW = "key string, path string, salt long, is_page int, page_id long, host string, verdict string"
_OUT = "page_id long, host string, path string, rule string, verdict string"


def _sweep(default: str):
    """Rows of each part in order of their keys, rules before pages: the stack holds the rules whose hosts enclose
    the key, outermost first."""
    def sweep(batches: Iterator[pa.RecordBatch]):
        part, stack = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, stack = row["part"], []
                while stack and not row["key"].startswith(stack[-1]["key"]):
                    stack.pop()
                if not row["is_page"]:
                    stack.append(row)
                    continue
                fits = [r for r in stack if row["path"].startswith(r["path"])]
                best = max(fits, key=lambda r: (len(r["host"] + r["path"]), len(r["host"]), r["verdict"]), default=None)
                rule = best["host"] + best["path"] if best else None
                out.append({"page_id": row["page_id"], "host": row["host"], "path": row["path"], "rule": rule,
                            "verdict": best["verdict"] if best else default})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))

    return sweep


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sample: int = 8192) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that decides, or null), verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the page's path begins with the rule's;
    the longest (host and path together) wins, then that of the longer host, then the larger verdict ("block" before
    "allow").  Where none fits, the verdict is ``default``.

    Pages and rules are cut into ranges of the sorted reversed-host keys at points of a bounded sample of pages (which
    moves work, not results; path and a hash of page_id split a host or URL of many pages).  A rule goes to every range
    that its interval touches, and one sweep per range, in order, keeps the enclosing rules on a stack.

    A null url, or one without "://", has an empty host and path.  Null fields of a rule: it is ignored.  Repeated pages
    are judged each, pages without id too.  No pages give no rows; other columns are ignored.
    """
    spark = prepare(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(host_key(F.col("host")).alias("key"), "path", F.xxhash64("page_id").alias("salt"), F.lit(1).alias("is_page"),
                       "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    listed = rules.filter("host is not null and path is not null and verdict is not null")
    listed = listed.select(host_key(F.col("host")).alias("key"), "path", F.lit(0).cast("long").alias("salt"), F.lit(0).alias("is_page"),
                           F.lit(None).cast("long").alias("page_id"), "host", "verdict")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = hash_sample(rows.select("key", "path", "salt"), sample, "salt", "key", "path").toArrow().to_pylist()
    points = sorted((r["key"], r["path"], r["salt"]) for r in found)
    parts = 4 * tasks
    splits = sorted({points[k * len(points) // parts] for k in range(1, parts)}) if points else []
    both = rows.mapInArrow(_deal_pages(splits), "part int, " + _ROW).unionAll(listed.mapInArrow(_deal_rules(splits), "part int, " + _ROW))
    ordered = both.repartition(tasks, "part").sortWithinPartitions("part", "key", "is_page", "path", "salt")
    return ordered.mapInArrow(_sweep(default), _OUT)
