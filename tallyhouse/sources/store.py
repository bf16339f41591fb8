"""Small files in a shared store, made once: how several writers agree.

A file is written in full under a name of its own and then published.  On a local or mounted path
publishing is a hard link, elsewhere a rename of Hadoop's file system; both fail if the name is
taken, and of several writers one gets it.  Stores whose rename replaces files (some object
stores) need a lock of their own.
"""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop(spark, path)
    return fs.exists(jpath)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder by name; none if it isn't there."""
    jpath, fs = _hadoop(spark, folder)
    if not fs.exists(jpath):
        return []
    return sorted(n for s in fs.listStatus(jpath) if not (n := s.getPath().getName()).startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    jpath, fs = _hadoop(spark, path)
    fs.delete(jpath, True)


def read_text(spark: SparkSession, path: str) -> str:
    jpath, fs = _hadoop(spark, path)
    stream = fs.open(jpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Publishes a file unless its name is taken; tells whether it did."""
    folder, _, name = path.rpartition("/")
    staged = f"{folder}/.{name}-{uuid.uuid4().hex}"
    jstaged, fs = _hadoop(spark, staged)
    out = fs.create(jstaged, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if str(fs.getUri().getScheme()) == "file":
            local = lambda p: urlparse(p).path if p.startswith("file:") else p
            try:
                os.link(local(staged), local(path))
            except FileExistsError:
                return False
            return True
        jpath, _ = _hadoop(spark, path)
        return not fs.exists(jpath) and fs.rename(jstaged, jpath)
    finally:
        fs.delete(jstaged, False)


def working_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; a temporary one only on one machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tallyhouse-work"
    folder = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_quietly_delete, spark, folder)
    return folder


def _quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may have gone before the interpreter ends
        pass


class VersionLog:
    """Numbered JSON records in a folder; each number is published once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def latest(self) -> tuple[int, dict]:
        """Number and record of the newest version; 0 and nothing before the first."""
        found = [n for n in names(self.spark, self.folder) if n.endswith(".json")]
        if not found:
            return 0, {}
        return int(found[-1].split(".")[0]), json.loads(read_text(self.spark, f"{self.folder}/{found[-1]}"))

    def publish(self, version: int, record: dict) -> bool:
        """False if another writer has published this version."""
        return create_if_absent(self.spark, f"{self.folder}/{version:012d}.json", json.dumps(record))

    def forget_before(self, version: int) -> None:
        for n in names(self.spark, self.folder):
            if n.endswith(".json") and int(n.split(".")[0]) < version:
                delete(self.spark, f"{self.folder}/{n}")


def read_parquet(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    """Rows of some folders; an empty table for none."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
