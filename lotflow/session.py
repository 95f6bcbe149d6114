"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "lotflow", cores: int | str = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.metricsEnabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on.

    All event times are UTC instants, so the session zone is pinned.  Adaptive execution coalesces small
    shuffle partitions and splits skewed join partitions.  Generated methods beyond 8,000 bytes are not compiled by
    the JVM, so longer ones (the validation rules) run as separate operators instead.  The number of shuffle partitions
    is the session's own.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that would be visible to one
    machine alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="lotflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def use_checkpoints(spark: SparkSession) -> None:
    """Give ``DataFrame.checkpoint`` a reliable folder if the cluster has not done so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small dimension as a VALUES list: planned as local data of known size, with no job to read it."""
    names = ", ".join(f.name for f in schema.fields)
    values = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    typed = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")
