"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset
(tests on one machine) is a temporary folder made and used; a cluster without it is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of a folder of this driver's own below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _ROOTS.setdefault("unset", "file://" + tempfile.mkdtemp(prefix="tallyhouse-"))
    if base not in _ROOTS:
        _ROOTS[base] = f"{base.rstrip('/')}/tallyhouse-{uuid.uuid4().hex}"
        atexit.register(_quietly_drop, spark, _ROOTS[base])
    return _ROOTS[base]


def drop(spark: SparkSession, uri: str) -> None:
    """Delete a folder by Hadoop's file system, so any store works.

    Shuffle files go when the driver collects the plans that made them, so it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _quietly_drop(spark: SparkSession, uri: str) -> None:
    try:
        drop(spark, uri)
    except Exception:  # the JVM may have gone before the interpreter ends
        pass


def new_uri(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return written_at(df, tag)[0]


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    uri = new_uri(spark, tag)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
