"""A ledger of paid calls: results stand under a hash of what was asked, so that no call is made twice.

A task's key is a hash of its type, the element's text and the crop: equal crops share a call. A Spark task makes many calls
and puts the results of each CALLS of them in place at once, as a file that counts from then on, whether or not
the task or the job ends; when it is through it puts one file in place of these. A task that is tried again makes none of the calls that stand. So a
lost executor or a killed driver costs no more than CALLS calls of each of its running tasks. An error of the client ends that call, not the
run: what succeeded is kept, and the run ends in an error that says how many calls are still open. Tasks write where pyarrow
does (file, s3, gs, hdfs), as those of object_reader read.

    <root>/*.parquet    key, task_type, result, error, attempts
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs
from ..sources.object_reader import opened

#: Calls whose results are put in place together, and how often a task does so, about.
CALLS, PARTS = 64, 64
ROW = "key string, task_type string, result string, error string, attempts int"
ARROW = pa.schema([("key", pa.string()), ("task_type", pa.string()), ("result", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])


class OpenCalls(RuntimeError):
    """Calls that no result stands for after a run."""


def key_of(task_type: Column, text: Column, crop: Column | None = None) -> Column:
    """The hash of a task: equal for equal types, texts and crops, whatever document they come from."""
    return F.sha2(F.to_json(F.struct(task_type.alias("t"), text.alias("x"), *([] if crop is None else [crop.alias("c")])), {"ignoreNullFields": "false"}), 256)


def results(spark: SparkSession, root: str) -> DataFrame:
    """key, task_type, result of every call that succeeded, one row a key."""
    try:
        rows = spark.read.schema(ROW).parquet(root)
    except AnalysisException as e:  # before the first call
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ROW)
    return rows.where("error is null").groupBy("key").agg(F.min("task_type").alias("task_type"), F.min("result").alias("result"))


def open_calls(tasks: DataFrame, root: str) -> DataFrame:
    """The tasks whose key has no result yet, one row a key. tasks: key, task_type and what the client reads."""
    return tasks.dropDuplicates(["key"]).join(results(tasks.sparkSession, root).select("key"), "key", "left_anti")


def put(store: pafs.FileSystem, rows: pa.Table, path: str) -> None:
    """Write a file that nobody sees before it is whole."""
    folder, _, name = path.rpartition("/")
    pq.write_table(rows, f"{folder}/_{name}", filesystem=store)
    store.move(f"{folder}/_{name}", path)


def there(store: pafs.FileSystem, path: str) -> pa.Table | None:
    return pq.read_table(path, filesystem=store, schema=ARROW, partitioning=None) if store.get_file_info(path).type == pafs.FileType.File else None


def run(tasks: DataFrame, make_client: Callable[[], object], root: str, retries: int = 1) -> DataFrame:
    """Make the calls that are open and return tasks with their result; OpenCalls if some failed for good.

    The client has describe_figure(row), reparse_table(row) and ocr_page(row), each returning text. ConnectionError and
    TimeoutError are tried again up to `retries` times. Unknown task types make no call and have no result.
    """
    spark, known, this = tasks.sparkSession, F.col("task_type").isin("visual_description", "table_reparse", "full_page_ocr"), uuid.uuid4().hex
    # what is open is found once
    wanted, aside = open_calls(tasks.where(known), root), runs.workspace(spark, "ledger-open")
    runs.write(wanted, aside)
    wanted = spark.read.schema(wanted.schema).parquet(aside)
    size = CALLS

    def called(rows: list[dict], client: object) -> pa.Table:
        out = []
        for row in rows:
            call = {"visual_description": client.describe_figure, "table_reparse": client.reparse_table, "full_page_ocr": client.ocr_page}[row["task_type"]]
            result, error, attempt = None, None, 0
            for attempt in range(1, retries + 2):
                try:
                    result, error = call(row) or "", None
                    break
                except (ConnectionError, TimeoutError) as e:
                    error = f"{type(e).__name__}: {e}"
                except Exception as e:  # the call's own failure, kept beside the others' results
                    error = f"{type(e).__name__}: {e}"
                    break
            out.append((row["key"], row["task_type"], result, error, attempt))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        store.create_dir(base, recursive=True)
        name = f"{base.rstrip('/')}/{this}-{TaskContext.get().partitionId():06d}"
        rows = (row for batch in batches for row in batch.to_pylist())
        client, own, paths = None, [], []
        whole = there(store, f"{name}.parquet")
        for no in itertools.count():
            some = list(itertools.islice(rows, size))
            if not some:
                break
            if whole is None:
                path = f"{name}-{no:06d}.parquet"
                done = there(store, path)
                if done is None:
                    client = client or make_client()
                    done = called(some, client)
                    put(store, done, path)
                own.append(done)
                paths.append(path)
        if whole is None and own:
            whole = pa.concat_tables(own)
            put(store, whole, f"{name}.parquet")
            for path in paths:
                store.delete_file(path)
        yield pa.RecordBatch.from_arrays([pa.array([whole["error"].null_count if whole is not None else 0], pa.int64())], names=["n"])

    n = wanted.count()
    if n:
        many = min(-(-n // CALLS), max(2 * spark.sparkContext.defaultParallelism, -(-n // (CALLS * PARTS))))
        # in order, so that a task that is tried again meets the same calls
        left = n - wanted.repartition(many, "key").sortWithinPartitions("key").mapInArrow(calls, "n bigint").agg(F.sum("n")).first()[0]
    runs.remove(spark, aside)
    if n and left:
        raise OpenCalls(f"{left} of {n} calls are still open; run again to make these alone")
    return tasks.join(results(spark, root).select("key", "result"), "key", "left")
