"""Where jobs cut their lineage: Parquet tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a saved table (compressed Parquet) and its rows up to which it may be broadcast; beyond either it is joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset: in local mode (tests) a temporary folder of the machine, elsewhere a ValueError, as each
    executor of a cluster would write to its own disk.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="symspark-")
        root = _own[sc.applicationId]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, free: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return it read back.

    Later plans start from files every executor can read, so a lost executor costs only its running tasks.
    free: the shuffle files of this write go as soon as it is done, not when the driver happens to collect its garbage.
    """
    if free:
        conf = df.sparkSession.conf
        before = conf.get(_FREE, None)
        conf.set(_FREE, "true")
        try:
            return save(df.select("*"), name, partition_by)
        finally:
            conf.unset(_FREE) if before is None else conf.set(_FREE, before)
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._symspark_path = path
    return kept


def save_sorted(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write `df` as a table in the shared folder, bucketed and sorted by `key`, so that joins and aggregations by it need no shuffle of it."""
    spark = df.sparkSession
    path, table = new_folder(spark, name), f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    kept = spark.table(table)
    kept._symspark_path, kept._symspark_table = path, table
    return kept


def saved_bytes(df: DataFrame) -> int:
    """Size of a table made by save()."""
    spark, path = df.sparkSession, df._symspark_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast where its measured bytes and rows are within the bounds; else as it is."""
    return F.broadcast(df) if saved_bytes(df) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else df


def remove(df: DataFrame) -> None:
    """Delete a table made by save() or save_sorted(); only when no live plan reads it any more."""
    spark, path = df.sparkSession, df._symspark_path
    if table := getattr(df, "_symspark_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
