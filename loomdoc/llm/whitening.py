"""Whitening of embeddings by a tiled covariance.

Entries become integers, x = floor(64 c) + 1000000, so that every sum is exact. The covariance is put
together from tiles: dimensions are cut into column blocks of TILE, a pair of column blocks is a
tile key. Rows are cut into row-blocks of ROWS; each gives its column blocks, which a shuffle
by row-block brings together. There the tile pairs are multiplied and added up within the
task, and the tasks' tiles are summed per tile. The driver assembles the dimensions squared
and decomposes them; nothing that grows with the rows passes through it.

Centred before multiplying: entries are taken less the whole number next to their mean, products and sums of
these are integers, and what is left of the mean (less than one half) is taken off the exact sums. So no digit
is lost to the offset, and reruns agree to the last bit.

Nulls: rows whose vector is null or empty, or holds null or non-finite entries, drop. So do rows of another
length than most (of equally many the longest), and of an entry of 2^34 or more in magnitude, which leave
no exact products. A null vec_id is kept; repeated rows count and are returned each. An empty table gives an
empty result. Components whose eigenvalue is zero, to the precision of doubles (all of them where one row or only
equal rows are left), have no unit variance to scale to: whitened is null. deviation is null where the exact
sum is no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of a column block, rows of a row-block.
TILE, ROWS = 32, 2048
#: x = floor(SCALE * c) + OFFSET; entries of LIMIT or more in magnitude have no exact products.
SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 34)
#: Eigenvalues of no more than this share of the largest are zero.
ZERO = 1e-12


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v of the rows that remain, but for their length."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integers(column: pa.Array, centre: np.ndarray) -> np.ndarray:
    """x less the centre of its dimension."""
    return np.floor(SCALE * matrix(column)).astype(np.int64) + OFFSET - centre


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of integers, exactly: by doubles where no sum of theirs leaves 53 bits."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * len(a) < 1 << 53:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    return a.T.astype(object) @ b.astype(object)


def column_blocks(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """row_block, col, n, kind, data: the column blocks of each row-block, as packed integers. rows: v."""
    schema = pa.schema([("row_block", pa.int64()), ("col", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = integers(batch.column(1).slice(lo, ROWS), centre)
                block = (batch.column(0)[0].as_py() << 32) + at
                at += 1
                out = []
                for col, left in enumerate(range(0, x.shape[1], TILE)):
                    part = np.ascontiguousarray(x[:, left : left + TILE])
                    kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(part).max() <= np.iinfo(k).max)
                    out.append((block, col, len(part), kind, part.astype(kind).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select(F.spark_partition_id().alias("part"), "v").mapInArrow(run, "row_block bigint, col int, n int, kind string, data binary")


def tiles(blocks: DataFrame) -> DataFrame:
    """i, j, at, total: for each tile (column blocks i <= j) the sums of products, row by row of the tile; for j = -1 the sums of column block i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], {}
        for batch in batches:
            for block, col, n, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, held = block, []
                x = np.frombuffer(data, kind).reshape(n, -1).astype(np.int64)
                held.append(x)
                total[col, -1] = total.get((col, -1), 0) + x.sum(0).astype(object)
                for i, y in enumerate(held):
                    total[i, col] = total.get((i, col), 0) + product(y, x)
        # one tile of each key leaves the task, whatever its rows
        for (i, j), t in total.items():
            values = pa.array([[Decimal(v) for v in t.ravel().tolist()]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), values], names=["i", "j", "tile"])

    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "col")
    own = met.mapInArrow(run, "i int, j int, tile array<decimal(38,0)>")
    return own.select("i", "j", F.posexplode("tile").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("total"))


@dataclass
class Whitening:
    """n rows; centre + rest / n is the mean of each dimension; components by falling eigenvalue."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    trace: float
    project: np.ndarray

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S, x - S / n) of each vector."""
        d = integers(column, self.centre)
        safe = self.n * (int(np.abs(d).max(initial=0)) + 1) < 1 << 62
        return (self.n * d if safe else self.n * d.astype(object)) - (self.rest.astype(np.int64) if safe else self.rest), d - (self.rest / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return x @ self.project


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of all rows (v of one length); None where there are none."""
    # sums of x in two parts, which no number of rows overflows: two numbers a dimension reach the driver
    x = F.floor(SCALE * F.col("c")).cast("bigint") + OFFSET
    low = F.lit((1 << 20) - 1).cast("bigint")
    sums = rows.select(F.posexplode("v").alias("k", "c")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(x, 20)).alias("hi"), F.sum(x.bitwiseAND(low)).alias("lo")).orderBy("k").collect()
    if not sums:
        return None
    n, total = sums[0].n, [(r.hi << 20) + r.lo for r in sums]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    dim = len(total)
    rest, second = np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in tiles(column_blocks(rows, centre)).collect():  # the dimensions squared
        if r.j < 0:
            rest[r.i * TILE + r.at] = int(r.total)
        else:
            width = min(TILE, dim - r.j * TILE)
            a, b = r.i * TILE + r.at // width, r.j * TILE + r.at % width
            second[a, b] = second[b, a] = int(r.total)
    cov = ((n * second - np.outer(rest, rest)) / (n * n)).astype(np.float64)
    e, u = np.linalg.eigh(cov)
    e, u = np.maximum(e[::-1], 0), u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
    k = min(components, dim)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(e[:k] > ZERO * e[0], 1 / np.sqrt(e[:k]), np.nan)
    return Whitening(n, centre, rest, e[:k], float(np.trace(cov)), u[:, :k] * scale)


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the covariance of all rows' whitened vectors less the identity, measured; over the components that have a scale."""
    live = np.flatnonzero(~np.isnan(w.project[0]))
    if not live.size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once = np.zeros((live.size, live.size)), np.zeros(live.size)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                y = w.whitened(w.centred(batch.column(0).slice(lo, ROWS))[1])[:, live]
                total += y.T @ y
                once += y.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel(), *once]], pa.list_(pa.float64()))], names=["t"])

    # components squared from each task, summed by place
    sums = rows.select("v").mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r.v for r in sums]) / w.n
    second, mean = flat[: live.size**2].reshape(live.size, -1), flat[live.size**2 :]
    return float(np.abs(second - np.outer(mean, mean) - np.eye(live.size)).max())


def whiten(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component."""
    spark, rows = vectors.sparkSession, usable(vectors, vec_id, embedding)
    none = spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return none
    rows = rows.where(F.size("v") == lengths.dim)
    w = fit(rows, components)
    error = identity_error(rows, w)
    live = ~np.isnan(w.project[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, v = (batch.column(c).slice(lo, ROWS) for c in (0, 1))
                scaled, x = w.centred(v)
                if scaled.dtype == object or int(np.abs(scaled).max()) ** 2 * scaled.shape[1] >= 1 << 63:
                    scaled = scaled.astype(object)
                deviation = [int(s) if s < 1 << 63 else None for s in (scaled * scaled).sum(1).tolist()]
                y = w.whitened(x)
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), mask=np.tile(~live, len(y))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.int64()), white], names=["vec_id", "deviation", "white"])

    out = rows.mapInArrow(run, "vec_id bigint, deviation bigint, white array<double>").select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    share = F.array(*[F.lit(float(e) / w.trace if w.trace else None).cast("double") for e in w.values])
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
