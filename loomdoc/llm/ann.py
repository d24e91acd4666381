"""Approximate nearest neighbours with an inverted multi-index.

A vector is cut into two halves, each quantised by a codebook of its own; the pair of
centroids is its cell, so K x K cells come from two books of K, which grows with the square
root of the number of vectors (CELL of them to a cell, MOST_CENTROIDS at most). A query sorts the
centroids of each half by inner product and walks the pairs by their sum with a heap,
until the cells that it has passed hold enough entries. Those entries are ranked by
their inner product in double precision.

The books and the share of entries to pass are fitted on at most SAMPLE vectors (chosen
by a hash of vec_id): the least share with which the sample's own queries find AIM of
their true neighbours. All vectors are indexed. Cells are packed into shards of about
SHARD entries; larger cells are split over several shards by a hash of vec_id. The probes
of a shard are split too, PROBES to a task, and each task gets the shard's entries.

Candidates are found by matrix products, whose last bits depend on a column's place; the
scores of those that reach the k-th one but for EPSILON are computed again, component by
component in one order, and ranked.

Of equal vectors the k + 1 with the least vec_id are kept as entries: no more of them can
be among k neighbours, as ties go to the smaller vec_id.

Nulls: vectors that are null, zero, of another length than most (of equally many the longest), or hold
null or non-finite components take no part, as queries or candidates; nor do null
vec_ids. A vec_id stands for one vector: repeated rows count once, and of different vectors under one
vec_id the least in the order of their components takes part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, to_batch

SAMPLE, QUERIES, ROUNDS, AIM = 20_000, 200, 6, 0.94
CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 32, 4, 1024
SHARD, PROBES, WALKS, EPSILON = 8192, 2048, 256, 1e-9


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v of the vectors that take part but for their length."""
    v = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.empty((0, 0))


def book(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of x by Lloyd's rounds from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def cells(x: np.ndarray, books: tuple) -> np.ndarray:
    half = books[0].shape[1]
    return nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])


def walk(q: np.ndarray, books: tuple, counts: np.ndarray, enough: float) -> list[int]:
    """Cells that hold entries, by falling sum of the two halves' inner products, until they hold enough."""
    half = books[0].shape[1]
    s, t = books[0] @ q[:half], books[1] @ q[half:]
    i_order, j_order = np.argsort(-s, kind="stable").tolist(), np.argsort(-t, kind="stable").tolist()
    s, t = s[i_order].tolist(), t[j_order].tolist()
    width = len(j_order)
    heap, out, have = [(-s[0] - t[0], 0, 0)], [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = i_order[i] * width + j_order[j]
        if counts[cell]:
            out.append(cell)
            have += counts[cell]
        # (i, j + 1) always follows (i, j); a row begins when the row above has begun
        if j + 1 < width:
            heapq.heappush(heap, (-s[i] - t[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(i_order):
            heapq.heappush(heap, (-s[i + 1] - t[0], i + 1, 0))
    return out


def fit(x: np.ndarray, k: int, centroids: int) -> tuple[tuple, float]:
    """The books, and the share of entries to pass, from sample vectors."""
    half = (x.shape[1] + 1) // 2
    books = (book(x[:, :half], centroids), book(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0)))
    at = cells(x, books)
    counts = np.bincount(at, minlength=len(books[0]) * len(books[1]))
    needed = []
    for q in range(0, len(x), max(1, len(x) // QUERIES)):
        true = np.argsort(-(x @ x[q]), kind="stable")[: k + 1]
        order = walk(x[q], books, counts, np.inf)
        passed = np.empty(counts.size)
        passed[order] = np.cumsum(counts[order]) / len(x)
        needed += [passed[at[c]] for c in true if c != q]
    return books, float(np.quantile(needed, AIM)) if needed else 1.0


def search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    v = valid(vectors, vec_id, embedding)
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    most = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return none
    v = v.where(F.size("v") == most.dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    # by a hash of the id: at most SAMPLE rows reach the driver
    sample = np.array([r.v for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    n_vectors = v.count()
    books, share = fit(sample, k, int(np.clip(np.sqrt(n_vectors / CELL), LEAST_CENTROIDS, MOST_CENTROIDS)))
    # one shuffle: rows lie by vector for both
    few = Window.partitionBy("v").orderBy("vec_id")
    entries = v.withColumn("copy", F.dense_rank().over(few)).where(F.col("copy") <= k + 1).select("v", "vec_id").select("vec_id", "v")
    shared = spark.sparkContext.broadcast(books)  # 2 x MOST_CENTROIDS half vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells(matrix(b.column(1)), shared.value), pa.int32())], names=["vec_id", "v", "cell"])

    entries = stash(entries.mapInArrow(assign, "vec_id bigint, v array<double>, cell int"), "ann-entries")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # MOST_CENTROIDS squared rows at most
        counts[r.cell] = r["count"]
    total = int(counts.sum())
    enough = max(k + 1, share * total)
    # shards: a large cell has several of its own, small neighbouring cells share one
    parts = np.maximum(1, -(-counts // SHARD))
    first, at, held = np.zeros(counts.size, np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > SHARD:
            at, held = at + 1, 0
        first[c] = at
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
        else:
            held += n
    plan = spark.sparkContext.broadcast((counts, first, parts, enough))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts, _ = plan.value
        for b in batches:
            c = b.column("cell").to_numpy()
            shard = first[c] + b.column("h").to_numpy() % parts[c]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("vec_id"), b.column("v"), b.column("cell")], names=["shard", "vec_id", "v", "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, parts, enough = plan.value
        schema = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])
        for b in batches:
            rows = []
            for i, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                by: dict[int, list[int]] = {}
                for c in walk(q, shared.value, counts, enough):
                    for s in range(int(first[c]), int(first[c] + parts[c])):
                        by.setdefault(s, []).append(c)
                rows += [(s, i, q, cs) for s, cs in by.items()]
                if len(rows) >= 2000:
                    yield to_batch(rows, schema)
                    rows = []
            if rows:
                yield to_batch(rows, schema)

    def rerank(lists: pa.Table, probes: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not lists.num_rows or not probes.num_rows:
            return schema.empty_table()
        x, ids, cell = matrix(lists.column("v")), lists.column("vec_id").to_numpy(), lists.column("cell").to_numpy()
        order = np.lexsort((ids, cell))
        x, ids, cell = x[order], ids[order], cell[order]
        width = counts.size
        out_q, out_v, out_s = [], [], []
        qs, qv, qc = probes.column("query_id").to_numpy(), matrix(probes.column("q")), probes.column("cells").to_pylist()
        for k0 in range(0, len(qs), 256):
            scores = qv[k0 : k0 + 256] @ x.T
            for r, q in enumerate(qs[k0 : k0 + 256]):
                open_ = np.zeros(width, bool)
                open_[qc[k0 + r]] = True
                ok = np.flatnonzero(open_[cell] & (ids != q))
                s = scores[r, ok]
                if ok.size > k:
                    # all that tie with the k-th stay, so ties go by vec_id
                    edge = np.partition(s, ok.size - k)[ok.size - k]
                    ok = ok[s >= edge - EPSILON * max(1.0, np.abs(s).max())]
                own = (x[ok] * qv[k0 + r]).sum(axis=1)
                order = np.lexsort((ids[ok], -own))[:k]
                out_q += [q] * order.size
                out_v.append(ids[ok[order]])
                out_s.append(own[order])
        if not out_q:
            return schema.empty_table()
        return pa.table([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], schema=schema)

    # a task walks for about WALKS queries
    queries = v.where(F.col("vec_id") % every == 0).repartition(-(-n_vectors // (every * WALKS)), "vec_id")
    placed = entries.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h")).mapInArrow(place, "shard int, vec_id bigint, v array<double>, cell int")
    probes = stash(queries.mapInArrow(probe, "shard int, query_id bigint, q array<double>, cells array<int>"), "ann-probes")
    per = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("parts"))  # a row for each shard
    probes = probes.join(per, "shard").select("shard", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "q", "cells")
    copies = per.select(F.col("shard").alias("wanted"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("copy"))
    placed = placed.join(copies, F.col("shard") == F.col("wanted")).select("shard", F.col("copy").alias("part"), "vec_id", "v", "cell")
    found = placed.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
