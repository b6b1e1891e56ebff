"""Shared scratch tables: the one place where lineage is cut.

Every table written here lies under the folder that the cluster names in
``spark.checkpoint.dir``, so any executor (or a replacement for a lost one) can
read it again.  Nothing is kept on a machine-local disk of a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _fallback:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _fallback[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _fallback[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path early, through the file system that holds it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop_path):
        return None
    stream = system.open(hadoop_path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Tables up to this many bytes (measured, as Parquet) may be sent to every executor.
BROADCAST_BYTES = 8 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the result has file statistics, so the planner sees its
    real size when it chooses a join, and columns can be pruned from it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table.scratch_path)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of a materialised table."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def sized(table: DataFrame, most: int | None = None) -> DataFrame:
    """A materialised table, marked for broadcast when its measured size is within the bound (BROADCAST_BYTES).

    Beyond the bound the join is left to the planner, which shuffles both sides.
    """
    return F.broadcast(table) if stored_bytes(table) <= (BROADCAST_BYTES if most is None else most) else table
