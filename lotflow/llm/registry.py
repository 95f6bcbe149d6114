"""The named queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document's words in SQL.
WORDS_SQL = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def components_sql(links: str, nodes: str) -> str:
    """CTEs ending in ``named(node, component)``, for a table of links (x, y) and one of nodes (node)."""
    return f"""both_ways as (select x, y from {links} union select y, x from {links}),
    reach(x, y) as (select node, node from {nodes} union select r.x, b.y from reach r join both_ways b on r.y = b.x),
    named as (select x as node, min(y) as component from reach group by x)"""
