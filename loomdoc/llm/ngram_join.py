"""N-gram Jaccard self-join under several global token orders, the classes it links and the links themselves.

A document's set is its distinct 5-word shingles as 64-bit hashes. Two sets of
similarity t or more share a token among the first n - ceil(t n) + 1 of each, under any
one order of all tokens; so they do under every order. Order 1 finds the candidates (by
the shuffle, in buckets of one token); candidates must meet under orders 2 and 3 as well,
in as many tokens as their sizes ask for (required()), before sets are compared in full.

All orders put frequent tokens last. Which those are is counted over all documents with
lossy counting: each task reports what it saw at least LOCAL_MIN times, and the HOT most
frequent become a bounded broadcast. The list decides only how fast the join is: any
order gives the same links.

Nodes are distinct texts. Pairs never become rows by the square of a bucket. What meets under
all orders is first gathered into families: each bucket has a leader, to which those are held
whose most populous bucket it is, again while buckets of more than BLOCK_NODES nodes reach into several families; the
rest of such buckets is held against one another: buckets of FEW nodes or less give a row for each two nodes,
and what shares too few tokens under the first order for similar sets (required(), again) goes before
anything is compared; larger ones are compared in blocks of bounded size, each of which
gives as few pairs as connect what meets. All links lie inside a family. A family's sets are
then compared in full, in blocks too, each two blocks in one task, which gives the number of
links of each node and as few pairs as connect what is linked.

Nulls: a null text is an empty set, linked with nothing; rows with the same doc_id are
documents each by itself; a null doc_id stands after all others. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, discard, flagged, gram_hashes, hashed_words, row_key, sieve, stash, text_slices, to_batch, unpacked, unused
from .components import components

SHINGLE, PERCENT, ORDERS = 5, 80, 3
#: Frequent tokens that the orders put last, and how often a task must see one to report it.
HOT, LOCAL_MIN, HOT_MIN = 400_000, 2, 12
#: Nodes and shingles of a block, about; members that one task compares to a leader.
BLOCK_NODES, BLOCK_SHINGLES, MEMBERS = 1000, 400_000, 1000
#: Leaders of a bucket, one after the other.
ROUNDS = 3
#: Tokens in more nodes of two blocks than this are counted by products of matrices, of so many columns at a time.
SHARED, COLUMNS = 32, 1024
#: Buckets of up to so many nodes give a row for each two of them.
FEW = 32
#: A task counts so many tokens at a time.
COUNTED = 3_000_000
#: Prefixes of up to so many tokens are compared by 16 bits of each, longer ones by 32.
NARROW = 4096


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each whole text, sorted."""
    counts, h = hashed_words(texts, lower=True)
    grams = gram_hashes(h, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(grams[at : at + n - k + 1])
            keep = np.ones(s.size, bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(gram_hashes(h[at : at + n], n) ^ np.uint64(n) if n else np.empty(0, np.uint64))
        at += n
    return out


def ranks(s: np.ndarray, order: int, hot: np.ndarray) -> np.ndarray:
    """The places of tokens under one of the global orders."""
    with np.errstate(over="ignore"):
        x = (s ^ (s >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[order])
    x = (x ^ (x >> np.uint64(32))) >> np.uint64(1)
    if hot.size and s.size:
        at = np.searchsorted(hot, s)
        x |= (hot[np.minimum(at, hot.size - 1)] == s).astype(np.uint64) << np.uint64(63)
    return x


def prefix(s: np.ndarray, order: int, hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set under an order: its frequent and its other tokens."""
    p = prefix_size(s.size, percent)
    r = ranks(s, order, hot)
    first = np.argpartition(r, p - 1)[:p] if p < s.size else np.arange(s.size)
    frequent = (r[first] >> np.uint64(63)).astype(bool)
    return s[first[frequent]], s[first[~frequent]]


def prefix_size(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def required(a: int | np.ndarray, b: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """How many tokens the prefixes of similar sets of sizes a and b share under any order, at least.

    Similar sets share s = ceil(percent (a + b) / (100 + percent)) tokens. Of these, those up to
    the end of the prefix that ends first are in both, and what a set has behind its prefix is
    its size less its prefix's.
    """
    shared = -(-percent * (a + b) // (100 + percent))
    return shared - np.maximum(a - prefix_size(a, percent), b - prefix_size(b, percent))


def others(s: np.ndarray, hot: np.ndarray) -> bytes:
    """The prefixes of a set under all orders but the first: the leading 16 bits of their tokens, of prefixes above NARROW 32 bits."""
    kind = np.uint32 if prefix_size(s.size) > NARROW else np.uint16
    return b"".join((np.concatenate(prefix(s, o, hot)) >> np.uint64(64 - 8 * kind().itemsize)).astype(kind).tobytes() for o in range(1, ORDERS))


def read_others(packed: bytes) -> list[np.ndarray]:
    """The distinct tokens of others(), by order."""
    kind = np.uint32 if len(packed) > 2 * NARROW * (ORDERS - 1) else np.uint16
    return [np.unique(x) for x in np.frombuffer(packed, kind).reshape(ORDERS - 1, -1)]


def narrow(x: np.ndarray) -> np.ndarray:
    """Distinct tokens cut to 16 bits."""
    return x if x.dtype == np.uint16 else np.unique((x >> np.uint32(16)).astype(np.uint16))


def may_be_similar(a: list[np.ndarray], b: list[np.ndarray], n: int, m: int) -> bool:
    """Whether nodes of sizes n and m meet under the other orders as similar ones must."""
    if a[0].dtype != b[0].dtype:
        a, b = [narrow(x) for x in a], [narrow(x) for x in b]
    # tokens that fell together when they were cut count as if they were shared
    spare, need = prefix_size(n) + prefix_size(m), required(n, m)
    return all(common(x, y) + spare - x.size - y.size >= need for x, y in zip(a, b, strict=True))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not a.size or not b.size:
        return 0
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, b.size - 1)] == a).sum())


def fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.coalesce((100 * a >= PERCENT * b) & (100 * b >= PERCENT * a), F.lit(False))


@dataclass
class Classes:
    """nodes: id, same, key, class_id, n of each distinct text; labels: id, root, n_links of those with a link; rows: doc_id, same, key of each document."""

    nodes: DataFrame
    labels: DataFrame
    rows: DataFrame


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, same, text: key tells rows apart, same is equal for equal texts."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return docs.select(row_key("doc_id", "text").alias("key"), "doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("same"), "text")


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """same, key, class_id, z of rows same, key, doc_id, text: texts are shuffled as zstandard frames."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at, texts in text_slices(batch.column(3)):
            own = pa.array([z.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in range(3)), own], names=["same", "key", "class_id", "z"])


def least(docs: DataFrame) -> DataFrame:
    """same, key, class_id, z of the least document of each text. Texts that one document has by itself stay where they are: what a sieve of the others lets through is shuffled."""
    docs = docs.where("text is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per = docs.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("c"))
    per = stash(per.select("same", F.col("first.key").alias("key"), "c"), "ngram-first")
    bits, place = sieve(per.where("c > 1"), "same")
    told = flagged(docs, place, bits, "maybe")
    framed = lambda d: d.select("same", "key", "doc_id", "text").mapInArrow(frames, "same binary, key binary, class_id bigint, z binary")
    several = framed(told.where("maybe")).join(per.select("same", "key"), ["same", "key"]).dropDuplicates(["same", "key"])
    return framed(told.where("not maybe")).unionByName(several)


def scan(one: DataFrame) -> DataFrame:
    """id, same, key, class_id, n, z (the text as a zstandard frame) of the least document of each text; and rows with tokens only: what tasks counted often."""
    schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("key", pa.binary()), ("class_id", pa.int64()), ("n", pa.int64()), ("z", pa.binary()), ("tokens", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            sets.clear()
            return to_batch([(None,) * 6 + (t[n >= LOCAL_MIN].view(np.int64), n[n >= LOCAL_MIN])], schema)

        held = 0
        for batch in batches:
            for at, own in sets_of(batch.column(4)):
                sizes = np.array([s.size for s in own], np.int64)
                nothing = pa.nulls(len(own), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(own)) for c in range(4)), pa.array(sizes), batch.column(4).slice(at, len(own)), nothing, nothing], schema=schema)
                sets += own
                held += int(sizes.sum())
                if held > COUNTED:
                    yield often()
                    held = 0
        yield often()

    return one.select(F.monotonically_increasing_id().alias("id"), "same", "key", "class_id", "z").mapInArrow(run, "id bigint, same binary, key binary, class_id bigint, n bigint, z binary, tokens array<bigint>, seen array<bigint>")


def hot_tokens(scanned: DataFrame) -> np.ndarray:
    """The most frequent tokens, sorted: the driver gets no more than HOT numbers. How many have which frequency, in bands, is read first."""
    counted = scanned.where(F.col("tokens").isNotNull()).select(F.explode(F.arrays_zip("tokens", "seen")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.seen").alias("n"))
    counted = stash(counted.where(F.col("n") >= HOT_MIN), "ngram-counts")
    band = F.floor(F.log2("n") * 16)
    total, lowest = 0, None
    for r in sorted(counted.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.band):
        total += r.c
        if total > HOT:
            break
        lowest = r.band
    rows = counted.where(F.lit(lowest is not None) & (band >= F.lit(lowest or 0))).select("token").toArrow()
    discard(counted)
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def first_prefixes(nodes: DataFrame, hot: Broadcast) -> DataFrame:
    """token, id, alone: a row for each token of each node's prefix under the first order; alone is the id where the token is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(1)):
                parts = [x for s in sets for x in prefix(s, 0, hot.value)]
                sizes = np.array([x.size for x in parts], np.int64)
                ids = np.repeat(batch.column(0).slice(at, len(sets)).to_numpy(), sizes.reshape(-1, 2).sum(1))
                seldom = np.repeat(np.arange(sizes.size) % 2 == 1, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(ids), pa.array(ids, mask=seldom)], names=["token", "id", "alone"])

    return nodes.where("n > 0").select("id", "z").mapInArrow(run, "token bigint, id bigint, alone bigint")


def other_prefixes(nodes: DataFrame, hot: Broadcast) -> DataFrame:
    """id, n, others: of each node its prefixes under all orders but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(sets)) for c in range(2)), pa.array([others(s, hot.value) for s in sets], pa.binary())], names=["id", "n", "others"])

    return nodes.where("n > 0").select("id", "n", "z").mapInArrow(run, "id bigint, n bigint, others binary")


def buckets(rows: DataFrame) -> DataFrame:
    """token, id: which nodes have which token in their prefix under the first order; other than frequent tokens of one node only are left out."""
    # a frequent token's bucket is not gathered in one task: each of its rows stands alone
    shared = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token", "alone")))
    return shared.where("c > 1 or alone is not null").select("token", "id")


def kinds(b: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, id, n, alike: buckets of two nodes or more; of those with the same nodes one, told by the number and two checksums of their nodes, and how many are alike. Nodes without another of a fitting size go."""
    code = F.xxhash64("id")
    per = b.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 20)).alias("s")).where("c > 1")
    one = per.groupBy("c", "x", "s").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("alike")).select("token", "alike")
    rows = b.join(one, "token").join(among(nodes.select("id", "n"), b), "id").select("token", "id", "n", "alike")
    by_size = Window.partitionBy("token").orderBy("n")
    near = rows.select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    return near.where(fits(F.col("n"), F.col("less")) | fits(F.col("n"), F.col("more"))).select("token", "id", "n", "alike")


def needed(a: str, b: str) -> Column:
    """required() of two columns of sizes."""
    return F.expr(f"({PERCENT} * ({a} + {b}) + {99 + PERCENT}) div {100 + PERCENT} - greatest(({PERCENT} * {a} + 99) div 100, ({PERCENT} * {b} + 99) div 100) + 1")


def of_few(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, id: two nodes of different families that share as many tokens under the first order as similar ones must, in buckets of FEW nodes or less; the rows of the other buckets).

    Similar nodes that are in no larger bucket together share all these tokens in small ones. rows: token, id, n, root, alike.
    """
    per = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    few, more = (rows.join(per.where(x).select("token"), "token") for x in (f"c <= {FEW}", f"c > {FEW}"))
    one = few.groupBy("token", "alike").agg(F.array_sort(F.collect_list(F.struct("id", "n", "root"))).alias("x"))
    one = one.select("alike", "x", F.posexplode("x").alias("at", "p")).select("alike", F.col("p").alias("a"), F.explode(F.expr("slice(x, at + 2, size(x))")).alias("b"))
    one = one.where((F.col("a.root") != F.col("b.root")) & fits(F.col("a.n"), F.col("b.n")))
    shared = one.groupBy(F.col("a.id").alias("leader"), F.col("b.id").alias("id"), F.col("a.n").alias("an"), F.col("b.n").alias("bn")).agg(F.sum("alike").alias("seen"))
    return shared.where(F.col("seen") >= needed("an", "bn")).select("leader", "id"), more


def to_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """leader, id: of each node the leader of its most populous bucket that has one of another family and of a fitting size. rows: token, id, n, root."""
    chosen = F.struct(F.xxhash64(F.lit(turn), F.col("id")), F.col("id").alias("leader"), F.col("n").alias("ln"), F.col("root").alias("lr"))
    leaders = rows.groupBy("token").agg(F.min(chosen).alias("x"), F.count(F.lit(1)).alias("c")).select("token", "c", "x.leader", "x.ln", "x.lr")
    held = rows.join(leaders, "token").where((F.col("root") != F.col("lr")) & fits(F.col("n"), F.col("ln")))
    return held.groupBy("id").agg(F.max(F.struct("c", "leader"))["leader"].alias("leader")).select("leader", "id")


def held_to_leaders(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """a, b: the pairs leader, id that meet under the other orders. A leader is sent once for MEMBERS of its members. prefixes: id, n, others."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "id").join(among(prefixes, pairs), "id")
    leaders = parts.join(among(prefixes.withColumnRenamed("id", "leader"), pairs, "leader"), "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("leader").alias("id"), "n", "others")
    rows = members.select(*leaders.columns).unionByName(leaders).repartition("leader", "part").sortWithinPartitions("leader", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            out = []
            for leader, role, i, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    own, size = read_others(packed), n
                elif may_be_similar(read_others(packed), own, n, size):
                    out.append((leader, i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.select("leader", "role", "id", "n", "others").mapInArrow(run, "a bigint, b bigint")


def sets_of(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of stretches of a column of texts as zstandard frames."""
    for at, texts in unpacked(column):
        yield at, shingle_sets(texts)


def others_of(column: pa.Array) -> Iterator[tuple[int, list]]:
    yield 0, [read_others(x) for x in column.to_pylist()]


def in_blocks(rows: DataFrame, payloads: DataFrame, sets_of: Callable, compared: Callable) -> DataFrame:
    """a, b, n: what compared(block) gives for each group of rows (group, id, n, root), or for each two blocks of a large one. payloads: id and what sets_of reads."""
    payload = next(c for c in payloads.columns if c != "id")
    per = rows.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per = per.select("group", F.ceil(F.greatest(F.col("c") / BLOCK_NODES, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("g"))
    # a cut into blocks is by the id, so that all rows of a node agree
    cut = rows.join(per, "group").select("group", "id", "root", "n", F.pmod(F.xxhash64("id"), "g").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    cut = cut.select("group", "id", "root", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = cut.join(among(payloads, rows), "id").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, out = None, Block(), []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n"])
                out.clear()

        for batch in batches:
            for at, sets in sets_of(batch.column(7)):
                some = [batch.column(c).slice(at, len(sets)).to_pylist() for c in range(7)]
                for group, i, j, node, root, n, own, s in zip(*some, sets, strict=True):
                    if (group, i, j) != now:
                        out += compared(block) if len(block.ids) > 1 else []
                        now, block = (group, i, j), Block()
                        if len(out) > 5000:
                            yield from flush()
                    block.add(node, root, n, int(own != i), s)
        out += compared(block) if len(block.ids) > 1 else []
        yield from flush()

    return full.select("group", "i", "j", "id", "root", "n", "own", payload).mapInArrow(run, "a bigint, b bigint, n bigint")


class Block:
    """Nodes that are compared with one another: their ids, families, sizes and sets; where sides differ, only across them."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.roots: list[int] = []
        self.sizes: list[int] = []
        self.sides: list[int] = []
        self.sets: list = []

    def add(self, node: int, root: int, size: int, side: int, s: object) -> None:
        self.ids.append(node)
        self.roots.append(root)
        self.sizes.append(size)
        self.sides.append(side)
        self.sets.append(s)

    def across(self) -> np.ndarray:
        """Which pairs lie across the sides, where there are two; else all of different nodes."""
        side = np.array(self.sides)
        return side[:, None] != side[None, :] if side.any() else ~np.eye(side.size, dtype=bool)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share."""
    m = len(sets)
    tokens, node = np.concatenate(sets), np.repeat(np.arange(m), [s.size for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, node = tokens[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if tokens.size else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [tokens.size]]))
    per = np.repeat(count, count)
    few = (per > 1) & (per <= SHARED)
    t, v, pairs = tokens[few], node[few], [np.empty(0, np.int64)]
    for k in range(1, SHARED):
        same = t[k:] == t[:-k]
        if not same.any():
            break
        pairs.append(v[:-k][same] * m + v[k:][same])
    both = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m).astype(np.int64)
    both += both.T
    many = per > SHARED
    if many.any():
        column, v = np.repeat(np.arange(count.size), count)[many], node[many]
        column = np.unique(column, return_inverse=True)[1]
        part = np.zeros((m, m), np.float32)
        for i, at in enumerate(range(0, int(column[-1]) + 1, COLUMNS), 1):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            x = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
            x[v[lo:hi], column[lo:hi] - at] = 1
            part += x @ x.T
            # exact while a float tells whole numbers apart: up to 2^24 columns
            if i * COLUMNS % (1 << 24) == 0:
                both += part.astype(np.int64)
                part[:] = 0
        both += part.astype(np.int64)
    return both


def connecting(ids: list[int], table: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, 0) of as few pairs as connect what a symmetric table connects."""
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(table, label[None, :], len(ids)).min(1))
        if (new == label).all():
            return [(ids[a], ids[b], 0) for a, b in enumerate(label.tolist()) if a != b]
        label = new


def meeting(block: Block) -> list[tuple[int, int, int]]:
    """For in_blocks, over prefixes under the other orders: pairs that connect nodes of different families that meet."""
    r, n = np.array(block.roots), np.array(block.sizes)
    pairs = block.across() & (r[:, None] != r[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :]))
    need = required(n[:, None], n[None, :])
    for o in range(ORDERS - 1):
        if not pairs.any():
            return []
        own = [narrow(x[o]) for x in block.sets]
        lost = prefix_size(n) - np.array([x.size for x in own])
        pairs &= shared_counts(own) + lost[:, None] + lost[None, :] >= need
        wide = np.flatnonzero(prefix_size(n) > NARROW)
        if wide.size > 1:
            own = [block.sets[k][o] for k in wide]
            lost = prefix_size(n[wide]) - np.array([x.size for x in own])
            pairs[np.ix_(wide, wide)] &= shared_counts(own) + lost[:, None] + lost[None, :] >= need[np.ix_(wide, wide)]
    return connecting(block.ids, pairs)


def similar(n: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Which sets of sizes n are linked that share so many tokens, in whole numbers."""
    return (both > 0) & (100 * both >= PERCENT * (n[:, None] + n[None, :] - both))


def linked(block: Block) -> list[tuple[int, int, int]]:
    """For in_blocks, over whole sets: (node, node, number of links) of each node, and pairs that connect what is linked."""
    table = similar(np.array(block.sizes, np.int64), shared_counts(block.sets)) & block.across()
    return [(i, i, c) for i, c in zip(block.ids, table.sum(1).tolist(), strict=True) if c] + connecting(block.ids, table)


def rooted(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with root, their family: of the buckets that reach into several."""
    if labels is None:
        return rows.withColumn("root", F.col("id"))
    rows = rows.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return rows.join(several, "token")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Classes:
    """The distinct texts and the components of their links."""
    docs = keyed(docs, doc_id, text)
    scanned = stash(scan(least(docs)), "ngram-nodes")
    hot = docs.sparkSession.sparkContext.broadcast(hot_tokens(scanned))  # HOT numbers at most
    nodes = scanned.where(F.col("id").isNotNull())
    # prefixes are made twice, so that they are never written: few nodes share a bucket, and bits tell which
    b = stash(buckets(first_prefixes(nodes, hot)), "ngram-buckets")
    rows = stash(kinds(b, nodes), "ngram-kinds")
    rest = stash(other_prefixes(among(nodes, rows), hot), "ngram-others")
    discard(b)
    families = None
    for turn in range(ROUNDS + 1):
        several = stash(rooted(rows, families), "ngram-several")
        if turn == ROUNDS or turn and several.groupBy("token").count().where(F.col("count") > BLOCK_NODES).isEmpty():
            break
        pairs = stash(to_leaders(several, turn), "ngram-pairs")
        families = labelled(families, held_to_leaders(pairs, rest))
        discard(several, pairs)
    shared, more = of_few(several)
    shared = stash(shared, "ngram-shared")
    blocks = in_blocks(more.withColumnRenamed("token", "group"), rest.select("id", "others"), others_of, meeting).select("a", "b")
    families = labelled(families, held_to_leaders(shared, rest).unionByName(blocks))
    discard(rows, several, shared, rest)
    group = families.join(among(nodes.select("id", "n"), families), "id").select(F.col("root").alias("group"), "id", "n", "root")
    found = stash(in_blocks(group, nodes.select("id", "z"), sets_of, linked), "ngram-linked")
    labels = labelled(None, found.where("n = 0").select("a", "b"))
    n_links = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    return Classes(nodes.drop("z", "tokens", "seen"), labels.join(n_links, "id", "left"), docs.select("doc_id", "same", "key"))


def labelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id, root of every node of the edges and of the components so far (labels)."""
    if labels is None:
        return stash(components(edges).withColumnRenamed("key", "id"), "ngram-labels")
    new = stash(edges, "ngram-edges")
    if new.isEmpty():
        return labels
    out = stash(components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(new)).withColumnRenamed("key", "id"), "ngram-labels")
    discard(labels, new)
    return out


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id: the least doc_id with the same text, and n_links: how many other texts are similar."""
    c = classes(docs, doc_id, text)
    nodes = c.nodes.where("n > 0").select("id", "same", "class_id", "n").join(c.labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = nodes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    nodes = nodes.join(least, "root").select("same", "class_id", "component_id", "n", "n_links")
    zero = F.lit(0).cast("bigint")
    own = lambda name: F.when(F.col("n").isNotNull(), F.col(name)).otherwise(F.col("doc_id")).alias(name)
    return c.rows.join(nodes, "same", "left").select("doc_id", F.coalesce("n", zero).alias("n_shingles"), own("component_id"), own("class_id"), F.coalesce("n_links", zero).alias("n_links"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the least of their component, with all their columns; of repeated rows one. Documents without words stay.

    Rows stay where they are unless a sieve of those that go or are repeated lets them through.
    """
    c = classes(docs, doc_id, text)
    key, maybe = unused(docs, "row_key", "maybe")
    order = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "id")
    first = c.nodes.where("n > 0").join(c.labels, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min_by("key", order).alias("key")).select("key")
    wordless = c.rows.join(c.nodes.where("n > 0").select("same"), "same", "left_anti").select("key")
    kept = stash(first.unionByName(wordless.distinct()), "ngram-kept")
    per = c.rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).join(kept.withColumn("kept", F.lit(True)), "key", "left")
    bits, place = sieve(stash(per.where("c > 1 or kept is null").select(F.col("key").alias(key)), "ngram-unsure"), key)
    told = flagged(docs.withColumn(key, row_key(doc_id, text)), place, bits, maybe)
    unsure = told.where(F.col(maybe)).join(kept.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])
    return told.where(~F.col(maybe)).unionByName(unsure).select(*docs.columns)
