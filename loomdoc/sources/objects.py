"""Objects (page images, crops, source files) on any storage that Hadoop file systems reach: put, get, delete, exists, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import object_reader, runs


def checked(key: str) -> str:
    if not key or key.startswith("/") or ".." in key.split("/"):
        raise ValueError(f"not an object key: {key}")
    return key


class Objects:
    """A store below one root (s3a://bucket/prefix, file:///folder, hdfs://..). An object's URI is its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def uri(self, key: str) -> str:
        return f"{self.root}/{checked(key)}"

    def _path(self, uri: str) -> tuple:
        """(file system, path) of a URI; one outside the root is an error."""
        if not uri.startswith(self.root + "/") or ".." in uri.split("/"):
            raise ValueError(f"not an object of this store: {uri}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, key: str, data: bytes) -> str:
        """Store one object and return its URI; one that stands there is replaced."""
        fs, path = self._path(self.uri(key))
        out = fs.create(path, True)
        try:
            out.write(data)
        finally:
            out.close()
        return self.uri(key)

    def put_all(self, rows: DataFrame) -> DataFrame:
        """Store the objects of rows(key, content) by the tasks that hold them, each replacing what stands there; uri and length of each. Lazy: the objects are there once the result is computed."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = object_reader.opened(root)
            for batch in batches:
                keys, sizes = batch.column(0).to_pylist(), []
                for key, content in zip(keys, batch.column(1).to_pylist(), strict=True):
                    checked(key)
                    if "/" in key:
                        fs.create_dir(f"{base}/{key}".rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(f"{base}/{key}") as out:
                        out.write(content)
                    sizes.append(len(content))
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{k}" for k in keys], pa.string()), pa.array(sizes, pa.int64())], names=["uri", "length"])

        return rows.select("key", F.col("content").cast("binary")).mapInArrow(run, "uri string, length bigint")

    def get(self, uri: str) -> bytes:
        self._path(uri)
        rows = self.spark.read.format("binaryFile").load(uri).select("content").collect()
        return bytes(rows[0].content)

    def delete(self, uri: str) -> None:
        """Remove an object; one that is not there stays so."""
        fs, path = self._path(uri)
        fs.delete(path, False)

    def exists(self, uri: str) -> bool:
        fs, path = self._path(uri)
        return bool(fs.exists(path))

    def listing(self, prefix: str = "") -> DataFrame:
        """uri, key, length, modified of all objects below a prefix, listed by Spark."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}".rstrip("/"))
        own = F.regexp_replace("path", "^file:/+", "file:///")
        at = F.length(F.lit(self.root)) + 2
        return files.select(own.alias("uri"), F.expr("substring(regexp_replace(path, '^file:/+', 'file:///'), {})".format(len(self.root) + 2)).alias("key"), "length", F.col("modificationTime").alias("modified")).where(at > 0)

    def contents(self, uris: DataFrame, column: str = "uri", content: bool = True) -> DataFrame:
        """uris with found, length and content (null without content=True), read by the executors; objects that are not there give no content.

        The wanted keys are written as a list, a file from each task of their shuffle; each file is a partition that opens
        its own objects. What else the store holds is neither listed nor read. A URI outside the store is an error.
        """
        key = F.when(F.col(column).startswith(self.root + "/"), F.expr(f"substring(`{column}`, {len(self.root) + 2})")).otherwise(F.raise_error(F.concat(F.lit("not an object of this store: "), F.col(column))).cast("string"))
        wanted = uris.where(F.col(column).isNotNull()).select(key.alias("key")).distinct()
        lists = runs.workspace(self.spark, "object-keys")
        runs.write(wanted, lists)
        object_reader.register(self.spark)
        held = self.spark.read.format("loomdoc_objects").option("root", self.root).option("keys", lists).option("content", str(content).lower()).load()
        held = held.select(F.concat(F.lit(self.root + "/"), "key").alias(column), "found", "length", "content")
        return uris.join(held, column, "left").withColumn("found", F.coalesce("found", F.lit(False)))
