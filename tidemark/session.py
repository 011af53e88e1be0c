"""Session settings the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to the Python workers in batches of about ``BATCH_BYTES``, unless the session sets a size of its own.

    By default a batch has up to 10,000 rows, which the executor and each worker hold at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


_BASES: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        app = spark.sparkContext.applicationId
        if app not in _BASES:
            _BASES[app] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        base = _BASES[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage: later steps read only the columns they need, and a lost executor costs no rerun.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        path = getattr(df, "stored_path", None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
