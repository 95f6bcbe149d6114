"""Exact duplicates by a stream with disk-backed keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.llm.common import prepare, stored
from lotflow.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the state is kept: on disk, with bounded memory, its changes rather than its files in the checkpoint, and without
#: files allocated ahead, which would take megabytes for every partition of however little state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def keyed_state(stream: DataFrame, state: str, checkpoint: str) -> None:
    """Run a stream of (doc_id, text, _metadata) over all it has, writing each batch's changed keys below ``state``.

    The state per key (digest and length) is the number of rows so far, the largest doc_id and the content locator
    of that row: the file and the row in it.  Nothing expires, and the state lies in RocksDB on disk, its changes in the
    shared checkpoint, from where another executor goes on.  Rows of a batch are combined before they reach the state,
    so a text that is a third of all rows gives each task one row.
    """
    spark = stream.sparkSession
    kept = F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keys = stream.select(digest(F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), kept.alias("kept"))
    groups = keys.groupBy("digest", "length").agg(F.count(F.lit(1)).alias("group_size"), F.max("kept").alias("kept"))

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        query = groups.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def exact_duplicates(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """One row per row of the documents at ``path`` (Parquet): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical byte by byte; a null text counts as empty.  Of equal texts the row with the largest
    doc_id stays.  Digests only find the hits: every row of a group of several is compared with the kept row's text in
    full, and rows that differ from it, or whose kept row isn't found by its locator, are grouped by their texts instead.

    Rows without doc_id are never the kept one of a group that has another, and of several rows with the kept
    doc_id and text all count as kept.  No rows give no rows; columns other than doc_id and text are not read.
    """
    prepare(spark)
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    root = shared_dir(spark, "exact-dedup")
    # A plain path of a stream must be a folder; a pattern that only this path matches may be a file, too.
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    keyed_state(stream, f"{root}/state", f"{root}/checkpoint")
    docs = spark.read.schema(schema).parquet(path)
    # Stored, so that both sides of the joins with it are shuffled for them and a hot text's partition can be split.
    return _decided(docs, stored(latest_state(spark, f"{root}/state"), "exact-state"))


STATE = ("digest string, length int, group_size long, kept struct<doc_id: bigint, file: string, row: bigint>, batch int")


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    """The last state of every key."""
    written = spark.read.schema(STATE).option("basePath", state).parquet(state)
    last = written.groupBy("digest", "length").agg(F.max_by(F.struct("group_size", "kept"), "batch").alias("last"))
    return last.select("digest", "length", "last.group_size", F.col("last.kept.doc_id").alias("keep_id"),
                       F.col("last.kept.file").alias("file"), F.col("last.kept.row").alias("row"))


def _decided(docs: DataFrame, state: DataFrame) -> DataFrame:
    """What becomes of each row, its text compared with the one that its group's locator points to."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, digest(F.col("text")).alias("digest"),
                       F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    hits = state.filter("group_size > 1").select("digest", "length", "file", "row")
    located = docs.select(text.alias("kept_text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    kept = located.join(hits, ["file", "row"]).select("digest", "length", "kept_text")
    key = ["digest", "length"]
    # Null where there was no text to compare with: rightly so in a group of one row only.
    same = F.col("text") == F.col("kept_text")
    checked = stored(rows.join(kept, key, "left").select("doc_id", *key, same.alias("same")), "exact-checked")
    decided = checked.join(state.select(*key, "group_size", "keep_id"), key)
    lost = checked.filter("same is null").join(hits.select(*key), key, "left_semi")
    unequal = checked.filter("not same").unionByName(lost).select(*key).distinct()
    if not unequal.isEmpty():
        # Equal digests of different texts, or a kept row not found again: these rows are grouped by the texts themselves.
        apart = rows.join(unequal, key, "left_semi")
        groups = apart.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        apart = apart.join(groups, [*key, "text"]).select("doc_id", *key, F.lit(False).alias("same"), "group_size", "keep_id")
        decided = decided.join(unequal, key, "left_anti").select(*apart.columns).unionAll(apart)
    return decided.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                          F.col("digest").alias("text_sha256"))
