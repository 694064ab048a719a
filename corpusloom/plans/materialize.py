"""Cutting lineage with tables in the shared checkpoint folder.

A loop over DataFrames needs its plan cut in every round. Blocks kept on executors
are lost with them, so rounds are written as Parquet below ``spark.checkpoint.dir``,
which all executors of a cluster share; a lost executor costs a reread, no more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of some 16 to 24 bytes that a join may broadcast after they were counted.
BROADCAST_ROWS = 1_000_000

_written: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only in local mode without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return str(root).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{checkpoint_root(spark)}/corpusloom-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back with a short plan."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """``df`` written once to the shared folder in buckets of its keys, one file each: joins on all keys read them without a shuffle.

    There are as many buckets as shuffle partitions, so that the other side of a join alone is dealt anew. dealt: an aggregation has put the rows of each bucket into one task.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"corpusloom_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/{name}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` materialized, and the aggregates ``measures`` of its rows, taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(k) for k, c in measures.items())))
    return out, seen.get


def bounded_broadcast(narrow: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow``, a few numbers a row, with a broadcast hint if it was counted to ``most`` rows at most; else for a join by shuffles."""
    return F.broadcast(narrow) if narrow.count() <= most else narrow


def release(spark: SparkSession) -> int:
    """Delete what this application has materialized; call it when results are written."""
    jvm, paths = spark.sparkContext._jvm, _written.pop(spark.sparkContext.applicationId, [])
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
