"""Streams: windowed event counts with late data, and incremental ingestion by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from .sessions import rocksdb


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total by event time; rows later than the watermark are left out of a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that a gap parts."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ingest(source: DataFrame, target: str, checkpoint: str | None = None, content: str = "content") -> StreamingQuery:
    """Add documents whose content hash has not been seen, batch by batch; the trigger takes what is there and ends.

    Which hashes were seen is keyed state in RocksDB: a batch looks up its own hashes and reads nothing
    of what is stored, however much that is. State and target belong together, so the checkpoint lies
    in the target unless another place is given. Each batch writes a folder of its own, batch=<number>, anew: a
    batch that is played again after a failure meets the state of the batch before it and replaces what it wrote.
    """
    hashed = source.withColumn("source_hash", store.content_hash(F.col(content))).dropDuplicates(["source_hash"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with rocksdb(source.sparkSession):
        return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{target}/_checkpoint").trigger(availableNow=True).start()
