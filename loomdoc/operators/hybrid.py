"""Hybrid search: BM25 over postings in order of impact, dense cosine, and reciprocal-rank fusion of both.

A posting's saturation r = tf (K1 + 1) / (tf + K1 (1 - B + B dl / avgdl)) lies in (0, K1 + 1) and has no part of the term's
rarity, so postings never change as rarities do. Postings are laid out by bands of r, BANDS to one unit, the
greatest first to be read; maxima() has the greatest and least r and the count of each term's band. They are a
few rows a term, and from them alone a search knows, for each query,
  floor    the k-th best score is at least this: the best single term's k-th posting has it
  bound    of a band: its greatest impact and the greatest of all other terms of the query
A document whose posting lies in a band below the floor cannot be among the k best, and a document among them has all its
postings in the other bands. So these are read, summed and ranked, and nothing is lost.

Impacts are whole numbers, floor(UNIT idf r), so that sums agree in any order.

What is read of the postings is dealt out by document, 16 bytes a posting, and scored there for all queries at once: a task hands on
no more than its k best of each query, so that scores are never shuffled by query and document.

Nulls: a null or empty text has no terms and counts as a document of length 0. Terms are runs of a-z and 0-9 in lower case.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

K1, B, BANDS, UNIT = 1.2, 0.75, 8, 1_000_000
RRF = 60
#: Queries are sent to all tasks only while they are no more than this.
MOST_QUERIES = 10_000
#: Documents whose postings go out together; postings that a task takes at a time, and sums (of documents by queries) that it holds at a time, about.
DOCS, ROWS, SUMS = 500, 200_000, 1 << 21

TERM = re.compile(b"[a-z0-9]+")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dl of rows id, text in lower case."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(TERM.findall(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.int64())], names=["dl"])


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dl, z of rows id, text in lower case: the terms of a text and how often it has each, as one zstandard frame."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        dl, out = [], []
        for t in batch.column(1).cast(pa.binary()).to_pylist():
            own = Counter(TERM.findall(t))
            dl.append(own.total())
            out.append(z.compress(b" ".join(own) + b"\n" + np.fromiter(own.values(), np.uint32, len(own)).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int64()), pa.array(out, pa.binary())], names=["id", "dl", "z"])


def opened(z: bytes) -> tuple[list[bytes], np.ndarray]:
    """(terms, how often) of a frame of counts()."""
    terms, _, n = zstandard.decompress(z).partition(b"\n")
    return terms.split(b" ") if terms else [], np.frombuffer(n, np.uint32).astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, first row of each key) of sorted rows, no key torn apart; the first n_keys columns are the key."""
    held: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            new[1:] = False
            for c in batch.columns[:n_keys]:
                v, x = np.asarray(c.is_valid()), c.fill_null(0).to_numpy()
                new[1:] |= (x[1:] != x[:-1]) | (v[1:] != v[:-1])
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = starts(batch)
        if held and first.size == 1 and starts(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])).size == 1:
            held.append(batch)
            continue
        own = pa.concat_batches([*held, batch])
        first = starts(own)
        held = [own.slice(first[-1])]
        if first.size > 1:
            yield own.slice(0, first[-1]), first[:-1]
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dl, term, tf of rows of counts() in order of id and dl; rows with equal ids and lengths count as one document."""
    for own, first in groups(batches, 2):
        for a, b in itertools.pairwise([*range(0, first.size, DOCS), first.size]):
            bounds = np.append(first, own.num_rows)[a : b + 1].tolist()
            terms, tfs, many = [], [], []
            for lo, hi in itertools.pairwise(bounds):
                t, n = opened(own.column(2)[lo].as_py())
                if hi > lo + 1:
                    sums = Counter(dict(zip(t, n.tolist(), strict=True)))
                    for k in range(lo + 1, hi):
                        t, n = opened(own.column(2)[k].as_py())
                        sums.update(dict(zip(t, n.tolist(), strict=True)))
                    t, n = list(sums), np.fromiter(sums.values(), np.int64, len(sums))
                terms += t
                tfs.append(n)
                many.append(len(t))
            at = pa.array(np.repeat(bounds[:-1], many))
            yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(np.concatenate(tfs))], names=["id", "dl", "term", "tf"])


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, id, r, band: a posting for each term of each document. docs: id and text. The rows of a document come from one task."""
    rows = docs.select(F.col("id").cast("bigint").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    mean = rows.mapInArrow(lengths, "dl bigint").agg(F.avg("dl").alias("avgdl"))
    own = rows.mapInArrow(counts, "id bigint, dl bigint, z binary").repartition("id", "dl").sortWithinPartitions("id", "dl")
    tf = own.mapInArrow(merged, "id bigint, dl bigint, term string, tf bigint")
    # one row: the join is a scalar look-up
    r = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.crossJoin(F.broadcast(mean)).select("term", "id", r.alias("r")).withColumn("band", F.floor(F.col("r") * BANDS).cast("int"))


def write(rows: DataFrame, path: str) -> None:
    """Postings in a folder for each band, by term within each task's file, so that a search opens the bands and row groups that it needs."""
    rows.sortWithinPartitions("band", "term", "id").write.partitionBy("band").parquet(path)


def maxima(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """term, band, most, least, n; of the terms asked alone (a column term), where a stated set of queries is given."""
    if asked is not None:
        rows = rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", "band").agg(F.max("r").alias("most"), F.min("r").alias("least"), F.count(F.lit(1)).alias("n"))


def impact(idf: str, r: str) -> Column:
    return F.floor(F.lit(float(UNIT)) * F.col(idf) * F.col(r)).cast("bigint")


def wanted(asked: DataFrame, bands: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """query_id, term, idf, band, n, needed: the bands of each query's terms, and whether any of the k best can have a posting there. asked: query_id, term; n_docs: one row, n_docs."""
    own = asked.join(bands, "term").crossJoin(F.broadcast(n_docs))
    term, best = Window.partitionBy("query_id", "term"), Window.partitionBy("query_id", "term").orderBy(F.desc("band"))
    own = own.withColumn("df", F.sum("n").over(term)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    own = own.withColumn("top", impact("idf", "most")).withColumn("peak", F.max("top").over(term)).withColumn("so_far", F.sum("n").over(best))
    own = own.withColumn("floor", F.when(F.col("so_far") >= k, impact("idf", "least")))
    query = Window.partitionBy("query_id")
    # peaks are summed once for each term: at its greatest band
    last = F.col("so_far") == F.col("n")
    own = own.withColumn("all", F.sum(F.when(last, F.col("peak"))).over(query)).withColumn("least_best", F.coalesce(F.max("floor").over(query), F.lit(0)))
    return own.select("query_id", "term", "idf", "band", "n", (F.col("all") - F.col("peak") + F.col("top") >= F.col("least_best")).alias("needed"))


def lexical(rows: DataFrame, bands: DataFrame, asked: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k best documents of each query with a score above 0, ties by id. rows: postings. About MOST_QUERIES queries at a time are sent to all tasks."""
    times = max(1, -(-asked.select("query_id").distinct().count() // MOST_QUERIES))
    own = [asked if times == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(times)) == i) for i in range(times)]
    return reduce(DataFrame.unionByName, (ranked(best(rows, wanted(x, bands, n_docs, k), k), k) for x in own))


def best(rows: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: what each task found best, the k best of each query among it. need: wanted()."""
    spark, kind = rows.sparkSession, need.schema["query_id"].dataType.simpleString()
    t = need.where("needed").select("query_id", "term", "band", "idf").toArrow().combine_chunks()
    queries = pa.chunked_array(t["query_id"]).combine_chunks().dictionary_encode(null_encoding="encode")
    terms, band = pa.chunked_array(t["term"]).combine_chunks().dictionary_encode(), t["band"].to_numpy().astype(np.int64)
    width = int(band.max(initial=0)) + 1
    # a slot is a band of a term
    slot, one, of = np.unique(terms.indices.to_numpy().astype(np.int64) * width + band, return_index=True, return_inverse=True)
    asking = queries.indices.to_numpy().astype(np.int64)[np.argsort(of, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=slot.size))]).astype(np.int64)
    slots = pa.table({"term": terms.dictionary.take(pa.array(slot // width)), "band": pa.array((slot % width).astype(np.int32)), "slot": pa.array(np.arange(slot.size)), "idf": t["idf"].to_numpy()[one]})
    slots = spark.createDataFrame(slots.cast(pa.schema([("term", pa.string()), ("band", pa.int32()), ("slot", pa.int64()), ("idf", pa.float64())])), "term string, band int, slot bigint, idf double")
    given = spark.sparkContext.broadcast((queries.dictionary, asking, ends))
    hits = rows.where(F.col("band").isin(np.unique(band).tolist())).join(F.broadcast(slots), ["term", "band"]).select("id", (F.shiftleft(impact("idf", "r"), 32) + F.col("slot")).alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asking, ends = given.value
        top = Top(len(names), k)
        for own, first in groups(together(batches), 1):
            score(top, own.column(0), own.column(1).to_numpy(), first, asking, ends)
        top.trim()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(top.query)), pa.array(top.id, pa.int64(), mask=top.none), pa.array(top.sum)], names=["query_id", "id", "score"])

    return hits.repartition("id").sortWithinPartitions("id").mapInArrow(run, f"query_id {kind}, id bigint, score bigint")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows, about."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Top:
    """The k best of each query among documents that come in order of their ids: of equal sums the first stay."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.least = n, k, np.zeros(n, np.int64)
        self.query, self.id, self.none, self.sum = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        self.more: list[tuple] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, none: np.ndarray, sums: np.ndarray) -> None:
        keep = sums > self.least[query]
        self.more.append((query[keep], ids[keep], none[keep], sums[keep]))
        self.held += int(keep.sum())
        if self.held > SUMS // 8:
            self.trim()

    def trim(self) -> None:
        query, ids, none, sums = (np.concatenate(x) for x in zip((self.query, self.id, self.none, self.sum), *self.more, strict=True))
        order = np.lexsort((np.arange(query.size), -sums, query))
        query, at = query[order], np.searchsorted(query[order], np.arange(self.n + 1))
        place = np.arange(query.size) - at[query]
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = sums[order][last]
        # the rest in the order in which it came
        kept = np.sort(order[place < self.k])
        self.query, self.id, self.none, self.sum = (x[kept] for x in (np.concatenate([self.query, *(m[0] for m in self.more)]), ids, none, sums))
        self.more, self.held = [], 0


def score(top: Top, ids: pa.Array, hits: np.ndarray, first: np.ndarray, asking: np.ndarray, ends: np.ndarray) -> None:
    """Adds the sums of documents to the best. hits: impact and slot of each posting; first: where each document's postings begin."""
    slot, s = hits & 0xFFFFFFFF, hits >> 32
    own = ids.take(pa.array(first))
    none = np.asarray(own.is_null())
    own = own.fill_null(0).to_numpy()
    last = np.append(first[1:], hits.size)
    step = max(1, SUMS // max(1, top.n))
    for a in range(0, first.size, step):
        b = min(a + step, first.size)
        lo, hi = first[a], last[b - 1]
        doc = np.repeat(np.arange(b - a), (last - first)[a:b])
        many = (ends[slot[lo:hi] + 1] - ends[slot[lo:hi]]).astype(np.int64)
        total, cells = np.cumsum(many), np.zeros((b - a) * top.n)
        at = 0
        while at < many.size:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2 * SUMS, "right")))
            m = many[at:to]
            begin = ends[slot[lo + at : lo + to]]
            place = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())
            # sums are exact in doubles: far below 2^53
            cells += np.bincount(np.repeat(doc[at:to], m) * top.n + asking[place], weights=np.repeat(s[lo + at : lo + to], m), minlength=cells.size)
            at = to
        found = np.flatnonzero(cells.reshape(b - a, top.n) > top.least)
        d = a + found // top.n
        top.add(found % top.n, own[d], none[d], cells[found].astype(np.int64))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best by query with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dense(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine of each query. points: id, dense; queries: query_id, vector, a stated set of MOST_QUERIES at most, against all points."""
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries at once; ask for {MOST_QUERIES} at most")
    # lengths are taken once for each vector, not for each two
    length = lambda x: F.sqrt(vectors.dot(F.col(x), F.col(x))).alias("length")
    lists = queries.select("query_id", "vector", length("vector")).agg(F.collect_list(F.struct("query_id", "vector", "length")).alias("qs"))
    one = points.select("id", "dense", length("dense")).crossJoin(F.broadcast(lists)).select("id", "dense", "length", F.explode("qs").alias("q"))
    cosine = vectors.dot(F.col("dense"), F.col("q.vector")) / F.nullif(F.col("length") * F.col("q.length"), F.lit(0.0))
    scored = one.select(F.col("q.query_id").alias("query_id"), "id", F.round(cosine, 9).alias("score")).where("score is not null")
    return ranked(scored, k)


def fused(*lists: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: reciprocal-rank fusion, in whole numbers (10^12 / (RRF + rank), summed)."""
    part = lambda x: x.select("query_id", "id", F.expr(f"1000000000000 div ({RRF} + rank)").alias("s"))
    rows = part(lists[0])
    for x in lists[1:]:
        rows = rows.unionByName(part(x))
    return ranked(rows.groupBy("query_id", "id").agg(F.sum("s").alias("score")), k)
