"""Binary documents: hashed scan, page parsing by a hook, upload plans, JSON export."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

PAGE_FACTS = "source_hash string, page_number bigint, text string, char_count bigint, drawings bigint, images bigint, width double, height double"


def scan(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """filename, uri, source_hash, content of the files below path, on any storage that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("uri"), store.content_hash(F.col("content")).alias("source_hash"), "content")


def parse_pages(files: DataFrame, make_parser: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Page facts of each file. The parser is made once for each Python worker's batch stream and gives a dict a page:
    text, drawings, images, width, height; pages number from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make_parser()
        for b in batches:
            rows = []
            for h, content in zip(b["source_hash"], b["content"], strict=True):
                for i, p in enumerate(parse(bytes(content)), 1):
                    rows.append((h, i, p["text"], len(p["text"].strip()), p.get("drawings", 0), p.get("images", 0), float(p["width"]), float(p["height"])))
            yield pd.DataFrame(rows, columns=["source_hash", "page_number", "text", "char_count", "drawings", "images", "width", "height"])

    return files.select("source_hash", "content").mapInPandas(run, PAGE_FACTS)


def upload_plan(files: DataFrame, documents: DataFrame, page_facts: DataFrame) -> DataFrame:
    """Files with page_count, the document of their hash and whether it is new; only new ones are stored and queued.

    documents: id, source_hash. Ids of new documents follow the largest, in the order of hashes.
    """
    counts = page_facts.groupBy("source_hash").agg(F.max("page_number").alias("page_count"))
    known = documents.groupBy("source_hash").agg(F.min("id").alias("known_id"))
    last = documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = files.select("source_hash").distinct().join(known, "source_hash", "left_anti").withColumn("one", F.lit(1))
    # hashes spread evenly: 4,096 buckets by their first three digits
    new = store.running_total(new, "source_hash", "one", F.substring("source_hash", 1, 3)).crossJoin(F.broadcast(last))
    new = new.select("source_hash", (F.col("last") + F.col("before") + 1).alias("new_id"))
    rows = files.select("filename", "uri", "source_hash").join(counts, "source_hash", "left").join(known, "source_hash", "left").join(new, "source_hash", "left")
    return rows.select("filename", "uri", "source_hash", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("known_id", "new_id").alias("document_id"), F.col("known_id").isNull().alias("created"))


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
