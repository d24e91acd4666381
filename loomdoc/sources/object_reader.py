"""A Spark data source of objects by their keys: a partition for each file of a written list of keys, and no byte read but theirs.

    spark.read.format("loomdoc_objects").option("root", "file:///store").option("keys", "file:///list").load()

The list is a folder of Parquet files with a column key; the driver sees the files' names only. Storage is what pyarrow
opens by URI: file, s3, gs, hdfs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, found boolean, length bigint, content binary"
ARROW = pa.schema([("key", pa.string()), ("found", pa.bool_()), ("length", pa.int64()), ("content", pa.binary())])
#: Keys read of a list at a time, and bytes after which a batch goes out.
KEYS, BYTES = 1024, 16 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.keys = options["root"].rstrip("/"), options["keys"].rstrip("/")
        self.with_content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.keys)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet"))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lists, _ = opened(self.keys)
        store, base = opened(self.root)
        out, size = [], 0
        with lists.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(KEYS, columns=["key"]):
                keys = batch.column(0).to_pylist()
                for key, info in zip(keys, store.get_file_info([f"{base}/{k}" for k in keys]), strict=True):
                    found, content = info.type == pafs.FileType.File, None
                    if found and self.with_content:
                        with store.open_input_stream(info.path) as o:
                            content = o.read()
                    out.append((key, found, info.size if found else None, content))
                    size += len(content or b"")
                    if size >= BYTES or len(out) >= KEYS:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomdoc_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ObjectReader:
        return ObjectReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)
