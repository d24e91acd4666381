"""A corpus pipeline: quality rules, near copies, repeated passages, mixing, token ids.

Each stage takes the table that its predecessor wrote and returns a table of the same
columns, the last one of token ids. Null and empty texts and repeated rows are documents
like any other in every stage; what becomes of them stands with the stage. An empty table
goes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm import mixing, ngram_join, quality_rules, sentencepiece_lattice, substring_dedup
from loomdoc.llm.common import discard, stash, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; repeated rows are judged each by itself."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, of repeated rows one; texts without words stay."""
    return ngram_join.first_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go from the text; n_chars follows. Documents that lose all their words go; null texts stay."""
    out = substring_dedup.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order: the order of the files and of the rows in them. Texts without words are never taken."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from files, with the number of each row in the order of the files' names and of the rows in them."""
    file, row, base = unused(docs, "file", "row", "base")
    rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # a row for each file: sent to the texts, which stay where they are
    before = rows.groupBy(file).agg(F.count(F.lit(1)).alias(base)).withColumn(base, F.sum(base).over(Window.orderBy(file)) - F.col(base))
    return rows.join(F.broadcast(before), file).withColumn(name, F.col(base) + F.col(row)).drop(file, row, base)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole document, its position in training, and whether the ids decode to its text. A null text has no ids."""
    (place,) = unused(docs, "place")
    rows = sentencepiece_lattice.documents(in_file_order(docs, place), public_tokenizers.path("piece_bpe_32k.model"), order=place)
    return rows.drop("key")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", drop_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Near-copy components and suffix automata are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again, and goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
