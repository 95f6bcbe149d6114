"""Small keyed tables as numbered Parquet versions on shared storage.

A writer prepares a whole new version aside and commits it by a rename that fails if the number is taken; then it
starts over from the version that was faster, so no update is lost.  A version knows the last batch of every stream that
went into it, so a batch is applied once, also if a stream gets a new checkpoint or several streams share a table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _folder(root: str, version: int) -> str:
    return f"{root}/version-{version:012d}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def make_folder(spark: SparkSession, name: str) -> None:
    """The folder, if there is none yet."""
    fs, path = _path(spark, name)
    fs.mkdirs(path)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of what is directly below ``root``."""
    fs, path = _path(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def finished(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions."""
    return sorted(int(n.removeprefix("version-")) for n in folders(spark, root) if n.startswith("version-"))


def read_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_folder(root, version))


def read_latest(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest version, or the newest below ``before``; no rows when there is none."""
    usable = [v for v in finished(spark, root) if before is None or v < before]
    return read_version(spark, root, schema, usable[-1] if usable else None)


def applied_batches(spark: SparkSession, root: str, version: int | None) -> dict[str, int]:
    """The last batch of each stream that is part of a version."""
    if version is None:
        return {}
    return json.loads(read_small(spark, f"{_folder(root, version)}/_applied") or "{}")


def read_small(spark: SparkSession, name: str) -> str | None:
    """A file of one line, such as a checkpoint's id; None if there is none."""
    fs, path = _path(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a folder unless the target exists."""
    _, source = _path(spark, staged)
    _, goal = _path(spark, target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, goal, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception):
            return False
        raise
    return True


def update(spark: SparkSession, root: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame],
           batch: tuple[str, int] | None = None) -> int | None:
    """Commit ``merge(newest version)`` as the next version and return its number.

    ``batch`` (stream, number) is remembered; a batch that is already part of the table is not applied again (None).
    """
    while True:
        known = finished(spark, root)
        newest = known[-1] if known else None
        done = applied_batches(spark, root, newest)
        if batch is not None:
            stream, number = batch
            if done.get(stream, -1) >= number:
                return None
            done[stream] = number
        staged, target = f"{root}/_new-{uuid.uuid4().hex}", (known[-1] + 1 if known else 0)
        merge(read_version(spark, root, schema, newest)).write.parquet(staged)
        fs, path = _path(spark, f"{staged}/_applied")
        out = fs.create(path)
        out.write(bytearray(json.dumps(done).encode()))
        out.close()
        if _commit(spark, staged, _folder(root, target)):
            return target
        fs, path = _path(spark, staged)
        fs.delete(path, True)


def expire(spark: SparkSession, root: str, keep: int = 20, hours: float = 24.0) -> None:
    """Remove all but the newest ``keep`` versions, none younger than ``hours``: longer than any reader holds one."""
    for version in finished(spark, root)[:-keep]:
        fs, path = _path(spark, _folder(root, version))
        if fs.exists(path) and fs.getFileStatus(path).getModificationTime() < (time.time() - hours * 3600) * 1000:
            fs.delete(path, True)


def add_version(table: DataFrame, root: str) -> int:
    """Commit the table as the next version, whatever was before."""
    return update(table.sparkSession, root, table.schema, lambda _: table)


def declare_table(spark: SparkSession, name: str, schema: T.StructType, location: str) -> None:
    """Create the table if it is absent."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}'")
