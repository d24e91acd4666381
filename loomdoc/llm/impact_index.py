"""Ranked lexical search over a bit-sliced impact index.

Terms are the maximal runs of digits, A-Z, a-z and anything past ASCII, A-Z in lower case. A document's
impact for a term is q = (1000000000 tf) div (1000 tf + 20 m), m = 100 - 50 + ((50 n N) div L), where N counts
the documents with a term, L all their terms, n the document's; its score for a query is the sum of w q
over the query's terms, once each, w = floor(1000 ln((2 N + 2) / (2 df + 1))).

The index: documents lie in blocks of at most BLOCK, in ascending doc_id order within a block. A row for
each term of a block holds its document frequency there, the places of its documents, and BITS bitmaps over
these, one for each bit of q. Blocks are made where their documents lie, without a shuffle.

A search opens a block's bitmaps of the queries' terms as whole numbers of BLOCK bits, multiplies each
term's by its w and adds those of a query, all by bitwise carries; the best of a block are found from the
most significant slice down. Blocks are independent; each task keeps the best of its own blocks, and these are ranked.

Queries are a stated set: they pass the driver in batches of TERMS terms, each batch against all blocks.

Nulls: a null text has no terms, nor has an empty one; such documents are never found and count in neither N nor L.
A null doc_id comes after all others among equal scores. Repeated rows are documents each, repeated
queries are ranked each. Terms of any length count whole; a very long text stands in a block by itself if it
exceeds BLOCK_BYTES. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, spread, stash, text_slices

#: Documents of a block (places take 16 bits) and the bytes of text after which a block ends.
BLOCK, BLOCK_BYTES = 16_384, 24 << 20
#: Bits of q, which is below 10^6.
BITS = 20
#: Distinct terms of a batch of queries.
TERMS = 100_000

#: Anything but digits, letters and bytes past ASCII parts terms; A-Z to lower case. On UTF-8 bytes.
PLAIN = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "block bigint, term string, df int, places binary, slices binary, doc_ids array<bigint>"
ARROW = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.binary()), ("slices", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def terms_of(text: Column) -> Column:
    """The terms of a text in order, as the JVM finds them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(PATTERN), F.lit(0))


def plain_bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """(where each text begins and the last ends, all texts one after the other with what parts terms as spaces, A-Z in lower case)."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    raw = memoryview(t.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return offsets - offsets[0], bytes(raw).translate(PLAIN)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(N, L) of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = total = 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                offsets, raw = plain_bytes(texts)
                inside = np.frombuffer(raw, np.uint8) != 0x20
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                # a term does not run from one text into the next
                first = offsets[:-1][np.diff(offsets) > 0]
                begins[first] = inside[first]
                n = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
                many, total = many + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64()), pa.array([total], pa.int64())], names=["many", "total"])

    r = docs.select("text").mapInArrow(run, "many bigint, total bigint").agg(F.sum("many"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def term_frequencies(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(document, code, tf) of each document's distinct terms, and the terms by code."""
    offsets, raw = plain_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    d = flat.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[filled]
    size = max(len(d.dictionary), 1)
    both, tf = np.unique(owner * size + d.indices.to_numpy()[filled], return_counts=True)
    return both // size, both % size, tf, d.dictionary.cast(pa.string())


def impacts(tf: np.ndarray, n: np.ndarray, stats: tuple[int, int]) -> np.ndarray:
    """q of each term frequency in a document of n terms."""
    many, total = stats
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * many) // total))


def posting_rows(block: int, ids: pa.Array, place: np.ndarray, code: np.ndarray, q: np.ndarray, terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """The index rows of a block: one without a term for its documents, then one for each term. place, code, q: its postings."""
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays([0, len(ids)], ids)], schema=ARROW)
    order = np.lexsort((place, code))
    place, code, q = place[order], code[order], q[order]
    df = np.bincount(code, minlength=len(terms))
    first = np.cumsum(df) - df
    width = (df + 7) // 8
    # a term's bitmaps follow each other: slice b begins at BITS * (bytes of a slice of all terms before) + b * (its own)
    at = np.cumsum(width) - width
    own = np.zeros(int(width.sum()) * 8, np.uint8)
    bit = spread(8 * at, df)
    slices = np.zeros(int(width.sum()) * BITS, np.uint8)
    to = spread(BITS * at, width)
    step = np.repeat(width, width)
    for b in range(BITS):
        own[bit] = (q >> b) & 1
        slices[to + b * step] = np.packbits(own, bitorder="little")
    packed = place.astype("<u2").tobytes()
    raw = slices.tobytes()
    seen = np.flatnonzero(df)
    sorted_terms = seen[pc.array_sort_indices(terms.take(pa.array(seen))).to_numpy()]
    for lo in range(0, seen.size, 4096):
        some = sorted_terms[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(some.size, block)), terms.take(pa.array(some)), pa.array(df[some], pa.int32()),
                pa.array([packed[2 * a : 2 * (a + n)] for a, n in zip(first[some].tolist(), df[some].tolist(), strict=True)], pa.binary()),
                pa.array([raw[BITS * a : BITS * (a + n)] for a, n in zip(at[some].tolist(), width[some].tolist(), strict=True)], pa.binary()),
                pa.nulls(some.size, pa.list_(pa.int64())),
            ],
            schema=ARROW,
        )


def build(docs: DataFrame, stats: tuple[int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index rows of all documents: block, term, df, places, slices; a row without a term holds a block's doc_ids. stats: (N, L)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = 0, 0
        ids: list[pa.Array] = []
        found: list[tuple] = []
        size = count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, found, size, count
            own = pa.concat_arrays(ids)
            # ties go to the lowest place, so places follow the ids
            rank = np.empty(len(own), np.int64)
            order = pc.array_sort_indices(own).to_numpy()
            rank[order] = np.arange(len(own))
            terms = pa.chunked_array([t for *_, t in found]).combine_chunks().dictionary_encode()
            codes, base = terms.indices.to_numpy(), 0
            out = []
            for place, code, q, t in found:
                out.append((rank[place], codes[base : base + len(t)][code], q))
                base += len(t)
            place, code, q = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from posting_rows((part << 32) + number, own.take(pa.array(order)), place, code, q, terms.dictionary)
            number, ids, found, size, count = number + 1, [], [], 0, 0

        for batch in batches:
            part = batch.column(0)[0].as_py()
            for at, texts in text_slices(batch.column(2)):
                for lo in range(0, len(texts), BLOCK):
                    some = texts.slice(lo, BLOCK)
                    own = pc.sum(pc.binary_length(some)).as_py() or 0
                    if count and (count + len(some) > BLOCK or size + own > BLOCK_BYTES):
                        yield from flush()
                    doc, code, tf, terms = term_frequencies(some)
                    n = np.bincount(doc, weights=tf, minlength=len(some)).astype(np.int64)
                    found.append((doc + count, code, impacts(tf, n[doc], stats), terms))
                    ids.append(batch.column(1).slice(at + lo, len(some)))
                    count, size = count + len(some), size + own
        if count:
            yield from flush()

    return docs.select(F.spark_partition_id().alias("part"), F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, INDEX)


def opened(places: bytes, slices: bytes, width: int) -> list[int]:
    """A term's bitmaps as numbers whose bits are a block's places."""
    at = np.frombuffer(places, "<u2")
    bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(BITS, -1), axis=1, count=at.size, bitorder="little")
    wide = np.zeros((BITS, width), np.uint8)
    wide[:, at] = bits
    return [int.from_bytes(r.tobytes(), "little") for r in np.packbits(wide, axis=1, bitorder="little")]


def add(a: list[int], b: list[int]) -> list[int]:
    """The sum of two bit-sliced numbers: a full adder on whole bitmaps from the least significant slice up."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for x, y in zip(a, b, strict=False):
        half = x ^ y
        out.append(half ^ carry)
        carry = x & y | half & carry
    for x in a[len(b) :]:
        out.append(x ^ carry)
        carry &= x
    return [*out, carry] if carry else out


def times(a: list[int], w: int) -> list[int]:
    """A bit-sliced number w times: shifted by each bit of w and added."""
    out: list[int] = []
    for k in range(w.bit_length()):
        if w >> k & 1:
            out = add(out, [0] * k + a)
    return out


def top(slices: list[int], k: int) -> list[tuple[int, int]]:
    """(place, number) of the k largest numbers above 0, from the most significant slice down; of equal ones the lowest places."""
    sure, open_ = 0, 0
    for s in slices:
        open_ |= s
    for s in reversed(slices):
        more = sure | open_ & s
        n = more.bit_count()
        if n > k:
            open_ &= s
        else:
            sure, open_ = more, open_ & ~s
            if n == k:
                open_ = 0
                break
    out = []
    for rest, most in ((sure, k), (open_, k - sure.bit_count())):
        while rest and most:
            low = rest & -rest
            place = low.bit_length() - 1
            out.append((place, sum((s >> place & 1) << i for i, s in enumerate(slices))))
            rest, most = rest ^ low, most - 1
    return out


def batches_of(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries (number, item_id, terms) in batches of about TERMS terms."""
    out, size = [], 0
    for number, r in enumerate(queries.toLocalIterator()):
        out.append((number, r.item_id, r.terms))
        size += len(r.terms)
        if size >= TERMS:
            yield out
            out, size = [], 0
    if out:
        yield out


def found_in(index: DataFrame, queries: list[tuple], stats: tuple[int, int], k: int) -> DataFrame:
    """number, doc_id, score: the best of each task's blocks for a batch of queries."""
    spark = index.sparkSession
    terms = sorted({t for _, _, ts in queries for t in ts})
    names = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, tid int"))  # TERMS and a query at most
    dfs = {r.tid: r.df for r in index.join(names, "term").groupBy("tid").agg(F.sum("df").alias("df")).collect()}
    weight = {i: math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * df + 1))) for i, df in dfs.items()}
    number = {t: i for i, t in enumerate(terms)}
    asked = spark.sparkContext.broadcast((weight, [(q, [i for t in ts if weight.get(i := number[t])]) for q, _, ts in queries]))
    own = index.where("term is not null").join(names, "term").select("block", "tid", "places", "slices", F.lit(None).cast("array<bigint>").alias("doc_ids"))
    rows = own.unionByName(index.where("term is null").select("block", F.lit(-1).alias("tid"), "places", "slices", "doc_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = asked.value
        best: dict[int, list] = {}
        now, ids, held = None, None, {}

        def close() -> None:
            for q, ts in wanted:
                total: list[int] = []
                for t in ts:
                    if t in held:
                        total = add(total, held[t])
                if not total:
                    continue
                own = best.setdefault(q, [])
                for place, score in top(total, k):
                    i = ids[place].as_py()
                    # the worst comes first in the heap: least score, then largest id, null last of all
                    heapq.heappush(own, (score, i is not None, -(i or 0), i))
                    if len(own) > k:
                        heapq.heappop(own)

        for batch in batches:
            for j, (block, t, places, slices) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if block != now:
                    close()
                    now, held = block, {}
                if t < 0:
                    ids = batch.column(4)[j].values
                elif t in weight:
                    held[t] = times(opened(places, slices, -(-len(ids) // 8) * 8), weight[t])
        close()
        out = [(q, x[3], x[0]) for q, own in best.items() for x in own]
        for lo in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[lo : lo + 10_000], strict=True)], names=["number", "doc_id", "score"])

    return rows.repartition("block").sortWithinPartitions("block", "tid").mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    stats = statistics(docs)
    if not stats[0]:
        return out
    index = stash(build(docs, stats), "impact-index")
    queries = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.array_sort(F.array_distinct(terms_of(F.col(item_text)))).alias("terms")).where(F.size("terms") > 0).orderBy("item_id", "terms")
    for batch in batches_of(queries):
        found = stash(found_in(index, batch, stats, k), "impact-found")  # at most k a query from each task
        names = spark.createDataFrame([(n, i) for n, i, _ in batch], "number bigint, item_id bigint")
        best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(names), "number")
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    discard(index)
    return out

