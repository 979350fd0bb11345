"""The scratch folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (a local master, as in tests) a local folder is
    made, which goes when Python ends. Elsewhere a session without one is an error: executors would write into
    folders that nobody else sees. Tables in the folder last as long as lazy results may read them; the
    owner of spark.checkpoint.dir clears it, or the caller does with delete().
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_seqloom_shared", None)
        if not base:
            held = tempfile.TemporaryDirectory(prefix="seqloom-", ignore_cleanup_errors=True)
            atexit.register(held.cleanup)
            base = spark._seqloom_shared = f"file://{held.name}"
    return f"{base.rstrip('/')}/seqloom-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: its lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
