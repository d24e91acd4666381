"""A vector collection on tables: exact cosine search with equality filters, upsert, delete, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filter_of(filters: dict | None) -> Column:
    """AND of field = value; no filter for none."""
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in (filters or {}).items()), F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def query(vectors: DataFrame, vector: list[float], top_k: int, filters: dict | None = None, id_col: str = "id", dense: str = "dense") -> DataFrame:
    """id, score and the payload of the top_k nearest by cosine; ties by id. The filter reaches the scan."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return vectors.where(filter_of(filters)).withColumn("score", cosine(F.col(dense), q)).where("score is not null").orderBy(F.desc("score"), id_col).limit(top_k)


def upsert(stored: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """stored with rows in place of those of the same key."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(stored: DataFrame, ids: list, key: str = "id") -> DataFrame:
    return stored.where(~F.col(key).isin(*ids)) if ids else stored


def delete_by_document(stored: DataFrame, document_id: int) -> DataFrame:
    return stored.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def stats(vectors: DataFrame, dense: str = "dense") -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("vector_count"), F.coalesce(F.max(F.size(dense)), F.lit(0)).cast("bigint").alias("dimension"))


def ensure_collection(spark: SparkSession, name: str, dimension: int) -> None:
    """Create the collection's table if it is missing; distance and dimension are table properties."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT, document_id BIGINT, dense ARRAY<FLOAT>, sparse STRUCT<indices: ARRAY<INT>, values: ARRAY<FLOAT>>, payload STRING) USING parquet "
        f"TBLPROPERTIES ('distance' = 'cosine', 'dimension' = '{int(dimension)}', 'sparse_modifier' = 'idf')"
    )


def payload(c: type[Column] | None = None) -> Column:
    return F.struct("chunk_id", "document_id", "chunk_type", "section_path", "page_start", "page_end", "element_ids", "model_family", "content_hash")


def embed(chunks: DataFrame, make_dense: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "content_text") -> DataFrame:
    """Pending chunks with their dense vectors; the model is made once for each Python worker's batch stream."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", dense array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_dense()
        for b in batches:
            yield b.assign(dense=model(b[text].tolist()))

    return chunks.where("embedding_status = 'pending'").mapInPandas(run, schema)


def sparse_terms(chunks: DataFrame, text: str = "content_text", buckets: int = 1 << 20) -> DataFrame:
    """chunks with sparse struct<indices, values>: term counts by hashed word; the inverse document frequencies stand beside the collection (idf())."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), F.lit(0))
    codes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    # made here, not at import: workers import this module without a session
    counted = F.arrow_udf(_term_counts, "struct<indices:array<int>,values:array<float>>")
    return chunks.withColumn("sparse", counted(codes))


def _term_counts(codes: pa.Array) -> pa.Array:
    """Distinct codes of each list in order, and how often each occurs, for a whole column at once. Words that share a code are one term."""
    n = len(codes)
    owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    both, count = np.unique((owner << 32) + codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    ends = pa.array(np.searchsorted(both >> 32, np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array((both & 0xFFFFFFFF).astype(np.int32)), pa.array(count.astype(np.float32)))]
    return pa.StructArray.from_arrays(lists, ["indices", "values"])


def idf(vectors: DataFrame) -> DataFrame:
    """index, idf over a collection's sparse vectors: ln((n - df + 0.5) / (df + 0.5) + 1)."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    df = vectors.select(F.explode("sparse.indices").alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("df"))
    # one row: the join is a scalar look-up
    return df.crossJoin(F.broadcast(n)).select("index", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def embed_and_upsert(chunks: DataFrame, vectors: DataFrame, make_dense: Callable[[], Callable[[list[str]], list[list[float]]]], document_id: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) after a document's pending chunks are embedded: their points replace those of the same id, and they are marked embedded.

    chunks: id, document_id, content_text, embedding_status, vector_id and more. Other
    documents' chunks stay pending. How many were embedded: embedded_count() before.
    """
    mine = chunks.where((F.col("document_id") == document_id) & (F.col("embedding_status") == "pending"))
    points = sparse_terms(embed(mine, make_dense)).select("id", "document_id", "dense", "sparse")
    done = (F.col("document_id") == document_id) & (F.col("embedding_status") == "pending")
    marked = chunks.withColumn("vector_id", F.when(done, F.col("id").cast("string")).otherwise(F.col("vector_id"))).withColumn("embedding_status", F.when(done, "embedded").otherwise(F.col("embedding_status")))
    return marked.select(*chunks.columns), upsert(vectors, points)


def embedded_count(chunks: DataFrame, document_id: int) -> DataFrame:
    """n: how many chunks of the document are pending, and so will be embedded."""
    return chunks.where((F.col("document_id") == document_id) & (F.col("embedding_status") == "pending")).agg(F.count(F.lit(1)).alias("n"))
