"""Folders that a table's writers fill run by run: a run counts once Spark's marker of a finished job stands in it, so what a killed writer leaves is never read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir = given = _own_dir or tempfile.mkdtemp(prefix="loomdoc-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, uri: str) -> tuple:
    """(file system, path) of a URI, by Hadoop."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def folders(spark: SparkSession, root: str, key: str) -> dict[int, str]:
    """number -> path of the folders key=<number> below root."""
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {int(n.removeprefix(f"{key}=")): f"{root}/{n}" for n in names if n.startswith(f"{key}=")}


def complete(spark: SparkSession, root: str, key: str) -> dict[int, str]:
    """The folders key=<number> below root whose job has finished, by number."""
    fs, _ = file_system(spark, root)
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))
    return {n: p for n, p in sorted(folders(spark, root, key).items()) if done(p)}


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Write a run whole; what an earlier attempt left there goes."""
    out = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (out.partitionBy(*by) if by else out).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        fs, path = file_system(spark, p)
        fs.delete(path, True)
