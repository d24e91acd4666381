"""Shared parts of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the whitespace kind: a run of anything but space and \t \n \v \f \r.
WORD = re.compile("[^\x20\x09-\x0d]+")

#: A-Z to lower case on UTF-8 bytes.
LOWER = bytes(range(256)).lower()

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loomdoc-")
    return _own_dir


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation of what came before."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in stashed:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_key(doc_id: str, text: str, *more: str) -> Column:
    """Tells rows of documents apart: equal only for rows with the same doc_id, text and further columns (128 bits)."""
    own = [F.col(c).cast("string") for c in more]
    sized = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(doc_id).cast("bigint").cast("string"), *own)]
    return F.unhex(F.md5(F.encode(F.concat(*sized, F.coalesce(F.concat(F.lit("="), F.col(text).cast("string")), F.lit("-"))), "UTF-8")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as df's columns ask for."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: Bits of a hashed sieve for each key, and at most.
SIEVE, MOST_BITS = 16, 1 << 28


def bitmaps(rows: DataFrame, place: Column) -> DataFrame:
    """at, bits: the places (whole numbers) that occur, a bit each, 32,768 to a row: what is sent to all tasks in place of keys."""
    return rows.where(place.isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def flagged(rows: DataFrame, place: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows, which stay where they are, with a column that tells whether bitmaps() hold their place; false for null."""
    own, at, bit, byte = unused(rows, "own", "at", "bits", "byte")
    within = F.bitmap_bit_position(place)
    out = rows.withColumn(own, F.bitmap_bucket_number(place)).join(F.broadcast(bits.toDF(at, bit)), F.col(own) == F.col(at), "left")
    out = out.withColumn(byte, F.conv(F.hex(F.substring(bit, (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"))
    found = F.floor(F.col(byte) / F.pow(F.lit(2), within % 8)) % 2 == 1
    return out.withColumn(name, F.coalesce(found, F.lit(False))).drop(own, at, bit, byte)


def among(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose id is one of the ids, without a shuffle: a bit for each id goes to all tasks. Ids are whole numbers in few dense stretches."""
    return flagged(rows, F.col(column), bitmaps(ids.select(column), F.col(column)), "_among").where("_among").drop("_among")


def sieve(keys: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(bitmaps, place of a key) of hashed keys: rows whose place isn't there have none of the keys, others may have. keys: a written table."""
    size = min(MOST_BITS, max(1, SIEVE * keys.count()))
    place = F.pmod(F.xxhash64(column), F.lit(size)) + 1
    return bitmaps(keys, place), place


#: Bytes of text that are taken apart at a time.
SLICE = 2 << 20


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about so many bytes, at least one row each."""
    at, total = 0, np.cumsum(sizes)
    while at < sizes.size:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def tidy() -> None:
    """Give back what this process has freed: workers outlive their tasks, and several stand beside each other on a machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of a column of texts."""
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), most):
        yield a, column.slice(a, b - a)
    tidy()


def unpacked(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of a column of zstandard frames."""
    opener, at, texts, size = zstandard.ZstdDecompressor(), 0, [], 0
    for z in column:
        texts.append(opener.decompress(z.as_py()) if z.is_valid else None)
        size += len(texts[-1] or b"")
        if size > most:
            yield at, pa.array(texts, pa.string())
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, pa.array(texts, pa.string())
    tidy()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each of the stretches."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if ends.size else 0)


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, the 64-bit hashes of all words in order, equal in every process); lower: of A-Z lower-cased texts."""
    t = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    d = flat.dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(d.dictionary))
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[filled]
    return np.bincount(owner, minlength=len(texts)), h[d.indices.to_numpy()[filled]]


def map_rows(df: DataFrame, schema: pa.Schema, ddl: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """mapInArrow where make(*columns as lists) yields result rows; output goes out in batches of 2,000 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in make(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                if len(rows) >= 2000:
                    yield to_batch(rows, schema)
                    rows = []
            if rows:
                yield to_batch(rows, schema)

    return df.mapInArrow(run, ddl)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k from the 64-bit hashes of their parts, by doubling; h.size - k + 1 of them."""
    out, have, bit = None, 0, h
    size = 1
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                out = bit if out is None else _join(out, bit, have, size)
                have += size
            k >>= 1
            if k:
                bit = _join(bit, bit, size, size)
                size *= 2
    return out


def _join(a: np.ndarray, b: np.ndarray, len_a: int, len_b: int) -> np.ndarray:
    """Hashes of runs of len_a + len_b that begin where a's runs begin."""
    n = a.size - len_b if a.size - len_b < b.size - len_a else b.size - len_a
    if n <= 0:
        return np.empty(0, np.uint64)
    x = a[:n] * np.uint64(0x9E3779B97F4A7C15) + (b[len_a : len_a + n] ^ (b[len_a : len_a + n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
