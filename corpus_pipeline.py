"""From documents to token ids: quality, boilerplate lines, near-duplicates, mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet into the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.llm.bpe import encode_decode
from lotflow.llm.common import stored
from lotflow.llm.lines import without_boilerplate
from lotflow.llm.minhash import near_duplicates
from lotflow.llm.mixing import mixed_documents
from lotflow.llm.quality import fit, score
from lotflow.llm.query_bpe import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, takes for good."""
    voter = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, voter).filter("quality_score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; a document that had nothing else stays, empty."""
    cut = without_boilerplate(docs, "source")
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """One row of equal doc_id and text, the least by its other columns; texts move only where hashes repeat."""
    key = [F.col("doc_id").isNull().alias("__k0"), F.xxhash64("doc_id").alias("__k1"), F.xxhash64("text").alias("__k2")]
    names = ["__k0", "__k1", "__k2"]
    again = stored(docs.select(*key).groupBy(*names).count().filter("count > 1").select(*names), "repeated-rows")
    if again.isEmpty():
        return docs
    keyed = docs.select("*", *key)
    least = keyed.join(again, names, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("__least"))
    return keyed.join(again, names, "left_anti").select(*docs.columns).unionByName(least.select("__least.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): of the smallest id, or without an id if none has one.

    Rows without doc_id are compared like the others, by an id made of their text; of rows with equal id and text, null
    ones included, one stays.
    """
    docs = _once(docs)
    unnamed = docs.filter("doc_id is null").select(F.xxhash64("text").alias("doc_id")).distinct()
    if unnamed.isEmpty():
        dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    named = docs.withColumn("__id", F.coalesce("doc_id", F.xxhash64("text")))
    found = near_duplicates(named.select(F.col("__id").alias("doc_id"), "text")).select("doc_id", "component_id").distinct()
    found = found.join(unnamed.withColumn("unnamed", F.lit(1)), "doc_id", "left").withColumn("rank", F.struct(F.coalesce("unnamed", F.lit(0)), "doc_id"))
    first = found.groupBy("component_id").agg(F.min("rank").alias("first"))
    dropped = found.join(first, "component_id").filter("rank <> first").select(F.col("doc_id").alias("__id"))
    return named.join(dropped, "__id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents are left out or repeated as their source's target asks."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of what they decode to."""
    coded = encode_decode(docs, vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("mix", mix), ("bpe", bpe)]
#: The classifier can't be stated in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
