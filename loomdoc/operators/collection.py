"""A vector collection on files: appended versions, resolved by readers.

Each upsert or delete appends one version of just its own rows; a deleted id is a row that says so. Readers
take the last row of each id. compact() writes what is live as a base; readers then look at the base and
the versions after it. A base is named by the last version that it holds, so versions that
are appended while it is written stay in force.

    <root>/version=<n>/*.parquet    id, document_id, dense, sparse, content_hash, payload, deleted
    <root>/base=<n>/*.parquet       the same, one row an id

A version or base counts once its job has finished, so a killed call changes nothing. Versions are numbered by
their writer: one writer at a time, any number of readers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import runs
from . import vectors

PAYLOAD = "struct<chunk_id:bigint,document_id:bigint,chunk_type:string,section_path:array<string>,page_start:bigint,page_end:bigint,element_ids:array<bigint>,model_family:string,content_hash:string>"
SPARSE = "struct<indices:array<int>,values:array<float>>"
ROW = f"id bigint, document_id bigint, dense array<float>, sparse {SPARSE}, content_hash string, payload {PAYLOAD}, deleted boolean"
#: Columns and their types, as ROW says.
TYPES = {c: t for c, t in (f.split(" ", 1) for f in ROW.split(", "))}


def checked(dense: Column, dimension: int) -> Column:
    """The vector, or an error where it is null or has another length."""
    n = F.coalesce(F.size(dense), F.lit(-1))
    return F.when(n == dimension, dense).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {dimension} components, not "), n.cast("string"))).cast("array<float>"))


class Collection:
    """Dense vectors under cosine, with sparse terms and a payload; one of them an id."""

    def __init__(self, spark: SparkSession, root: str, dimension: int):
        self.spark, self.root, self.dimension = spark, root.rstrip("/"), dimension

    def _append(self, rows: DataFrame) -> int:
        """Write a version and return how many rows it has, counted as they are written."""
        version = max([*runs.folders(self.spark, self.root, "version"), *runs.folders(self.spark, self.root, "base")], default=0) + 1
        seen = Observation()
        runs.write(rows.select(*TYPES).observe(seen, F.count(F.lit(1)).alias("n")), f"{self.root}/version={version}")
        return seen.get["n"]

    def upsert_vectors(self, rows: DataFrame, order: str | None = None) -> int:
        """Append rows (id, dense and, if there, document_id, sparse, content_hash, payload); of equal ids in rows the last by order. Returns how many.

        Only these rows are written. Without an order, equal ids must not occur: of such the one with the greatest content counts.
        """
        own = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in TYPES.items() if c not in ("deleted", "dense")]
        rows = rows.select(*own, checked(F.col("dense").cast("array<float>"), self.dimension).alias("dense"), F.lit(False).alias("deleted"), (F.col(order) if order else F.lit(0)).alias("_order"))
        rest = [c for c in TYPES if c not in ("id", "payload", "sparse")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in TYPES if c != "id"]), F.struct("_order", *rest)).alias("r"))
        return self._append(last.select("id", "r.*"))

    def delete(self, ids: DataFrame | list[int]) -> int:
        """Delete the points with these ids; others stay, ids without a point too."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        rows = ids.select(F.col("id").cast("bigint")).distinct()
        return self._append(rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in TYPES.items() if c not in ("id", "deleted")], F.lit(True).alias("deleted")))

    def delete_by_document(self, document_id: int) -> int:
        """Delete every point of a document and no other."""
        return self.delete(self.points({"document_id": document_id}).select("id"))

    def points(self, filters: dict | None = None) -> DataFrame:
        """The live points. Filters reach the scan of the base; versions after it are resolved first."""
        bases, versions = runs.complete(self.spark, self.root, "base"), runs.complete(self.spark, self.root, "version")
        base = max(bases, default=0)
        where = vectors.filter_of(filters)
        held = self.spark.read.schema(ROW).parquet(bases[base]) if bases else self.spark.createDataFrame([], ROW)
        after = [self.spark.read.schema(ROW).parquet(p).withColumn("version", F.lit(n)) for n, p in versions.items() if n > base]
        if not after:
            return held.where(where).drop("deleted")
        later = after[0]
        for more in itertools.islice(after, 1, None):
            later = later.unionByName(more)
        last = later.groupBy("id").agg(F.max_by(F.struct(*[c for c in TYPES if c != "id"]), "version").alias("r")).select("id", "r.*")
        old = held.where(where).join(later.select("id").distinct(), "id", "left_anti")
        return old.unionByName(last.where(~F.col("deleted")).where(where)).drop("deleted")

    def query(self, vector: list[float], top_k: int, filters: dict | None = None) -> DataFrame:
        """id, score and payload of the top_k nearest by cosine among the points that have the filters' values; ties by id."""
        return vectors.query(self.points(filters), vector, top_k).select("id", "score", "payload")

    def get_collection_stats(self) -> DataFrame:
        """vector_count, dimension (0 in an empty collection, as no vector has one)."""
        return vectors.stats(self.points())

    def compact(self) -> None:
        """Write the live points as a base; no answer changes."""
        last = max(runs.complete(self.spark, self.root, "version"), default=0)
        if last > max(runs.complete(self.spark, self.root, "base"), default=0):
            runs.write(self.points().withColumn("deleted", F.lit(False)), f"{self.root}/base={last}")

    def vacuum(self) -> None:
        """Remove the versions and bases that the last base replaces."""
        base = max(runs.complete(self.spark, self.root, "base"), default=0)
        for key, least in (("version", base + 1), ("base", base)):
            runs.remove(self.spark, *(p for n, p in runs.folders(self.spark, self.root, key).items() if n < least))


def pending(chunks: DataFrame, collection: Collection) -> DataFrame:
    """The chunks that have no live point of the same id and content_hash. So a chunk's state is what the collection says, and embedding is one commit: the version that holds its point."""
    done = collection.points().select("id", "content_hash")
    return chunks.join(done, ["id", "content_hash"], "left_anti")


def states(chunks: DataFrame, collection: Collection) -> DataFrame:
    """chunks with vector_id and embedding_status: embedded where their point is live, else pending."""
    done = collection.points().select("id", "content_hash", F.lit(True).alias("_done"))
    rows = chunks.drop("vector_id", "embedding_status").join(done, ["id", "content_hash"], "left")
    return rows.withColumn("vector_id", F.when(F.col("_done"), F.col("id").cast("string"))).withColumn("embedding_status", F.when(F.col("_done"), "embedded").otherwise("pending")).drop("_done")


def embed_and_upsert(chunks: DataFrame, collection: Collection, make_dense: Callable[[], Callable[[list[str]], list[list[float]]]], document_id: int | None = None) -> int:
    """Embed the pending chunks, of one document or of all, and upsert their points; how many, 0 where none is pending.

    chunks: id, document_id, content_text, content_hash and, for the payload, chunk_type, section_path, page_start, page_end,
    element_ids, model_family as far as they are there. A run that is killed leaves all of them pending.
    """
    mine = pending(chunks if document_id is None else chunks.where(F.col("document_id") == document_id), collection)
    if mine.isEmpty():
        return 0
    fields = dict(f.split(":", 1) for f in PAYLOAD.removeprefix("struct<").removesuffix(">").split(",") if ":" in f)
    own = lambda c: F.col("id") if c == "chunk_id" else F.col(c) if c in chunks.columns else F.lit(None)
    made = vectors.sparse_terms(vectors.embed(mine.withColumn("embedding_status", F.lit("pending")), make_dense))
    payload = F.struct(*[own(c).cast(t).alias(c) for c, t in fields.items()])
    return collection.upsert_vectors(made.withColumn("payload", payload))
