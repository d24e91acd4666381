"""Removal of passages that stand in an earlier document, by suffix automata of reference shards.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts
in a document with a smaller doc_id.

The reference is the corpus itself, so automata of all of it cannot be broadcast: they
have no size bound. It is cut into shards that meet by key instead. Each window is
assigned to its anchor, the least of its GRAM-word runs by hash: equal windows have equal
anchors, so a window needs only the shard of its anchor. Neighbouring windows with one
anchor form a segment. Anchors of one document only are left out; equal segments count
once, with their least document. For each remaining anchor the distinct segments, least
document first, are streamed through a suffix automaton of those before (matching
statistics; a match of WINDOW words or more ends a window that stands there) and then
added to it. The segments of an anchor with more than MAX_SEGMENTS distinct ones are cut
again in the same way, by the 2, 4, .. least runs of each window in place of the least one.

Nulls: a null text has no words; a null doc_id stands after all others, and never before
another null. Rows with the same doc_id are not earlier than one another. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, hashed_words, map_rows, row_key, stash, text_slices, to_batch, unused

WINDOW, GRAM = 50, 20
#: Distinct segments of an anchor that one automaton takes.
MAX_SEGMENTS = 400
LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.split() parts at exactly space and 09-0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def least_of_each(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours, by doubling."""
    size = 1
    while 2 * size <= k:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: x.size - k + size], x[k - size :])


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM, level: int = 1) -> tuple[np.ndarray, ...]:
    """Of each segment: anchor, hash of all its words, first window, number of windows. h: the words' hashes; level: how many least runs make an anchor."""
    n = h.size - window + 1
    if n < 1:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    grams, whole = gram_hashes(h, gram), gram_hashes(h, window)
    if level == 1:
        anchor = least_of_each(grams, window - gram + 1)
    else:
        views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
        anchor = np.empty(n, np.uint64)
        for k in range(0, n, 1 << 16):
            least = np.sort(views[k : k + (1 << 16)], axis=1)[:, :level]
            anchor[k : k + (1 << 16)] = [gram_hashes(x, x.size)[0] for x in least]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    with np.errstate(over="ignore"):
        # all windows, each with its place: where an anchor repeats, a segment can be longer than its first and last window
        place = np.arange(n, dtype=np.uint64) - np.repeat(first, count).astype(np.uint64)
        mixed = (whole ^ (whole >> np.uint64(31))) * (np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD6E8FEB86659FD92))
        own = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), first) + count.astype(np.uint64)
        own = (own ^ (own >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return anchor[first], own, first, count


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self.extend(last, w)

    def extend(self, last: int, w: object) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self.clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self.clone(p, q, w)
        return new

    def clone(self, p: int, q: int, w: object) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def match_lengths(self, words: list) -> Iterator[int]:
        """The matching statistics: for each place the longest run ending there that stands in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            yield n


def standing(words: list, automaton: Automaton, window: int = WINDOW) -> list[int]:
    """The starts of the windows of words that stand in the automaton."""
    return [i - window + 1 for i, n in enumerate(automaton.match_lengths(words)) if n >= window]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return docs.select(row_key("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "doc_id", "text")


def all_segments(docs: DataFrame) -> DataFrame:
    """key, doc and, as arrays, the segments of each document that has a window."""
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("anchor", "segment")), *((c, pa.list_(pa.int32())) for c in ("first", "count"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(2)):
                n, h = hashed_words(texts)
                ends = np.cumsum(n)
                some = (batch.column(c).slice(at, len(texts)).to_pylist() for c in (0, 1))
                rows = []
                for key, doc, a, b in zip(*some, (ends - n).tolist(), ends.tolist(), strict=True):
                    if b - a >= WINDOW:
                        anchor, own, first, count = segments(h[a:b])
                        rows.append((key, doc, anchor.view(np.int64), own.view(np.int64), first, count))
                if rows:
                    yield to_batch(rows, schema)

    return docs.select("key", "doc", "text").mapInArrow(run, "key binary, doc bigint, anchor array<bigint>, segment array<bigint>, first array<int>, count array<int>")


def shared_segments(segs: DataFrame) -> DataFrame:
    """anchor, segment, key, doc, first, count: a row for each segment whose anchor stands in two documents."""
    anchors = segs.select("doc", F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    # written: a join of two plain shuffles can be split where an anchor is frequent
    anchors = stash(anchors, "substring-anchors")
    rows = segs.select("key", "doc", F.explode(F.arrays_zip("anchor", "segment", "first", "count")).alias("s")).select("s.*", "key", "doc")
    return rows.join(anchors, "anchor")


def cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, segment, doc, words, hot: the words of the wanted segments, joined by spaces."""
    by_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "doc", "first", "count", "hot")).alias("wanted"))
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("words", pa.binary()), ("hot", pa.bool_())])

    def make(texts: list, lists: list) -> Iterator[tuple]:
        for text, wanted_ in zip(texts, lists, strict=True):
            words = words_of(text)
            for x in wanted_:
                yield x["anchor"], x["segment"], x["doc"], b" ".join(words[x["first"] : x["first"] + x["count"] + WINDOW - 1]), x["hot"]

    one = docs.select("key", "text").join(by_doc, "key").dropDuplicates(["key"]).select("text", "wanted")
    return map_rows(one, schema, "anchor bigint, segment bigint, doc bigint, words binary, hot boolean", make)


def by_automata(cuts: DataFrame) -> DataFrame:
    """anchor, segment, starts: windows of each segment that stand in a segment of an earlier document."""
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = doc = automaton = None
        waiting: list[list[bytes]] = []  # of the present document: it isn't earlier than itself
        for batch in batches:
            rows = []
            for a, g, d, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    anchor, doc, automaton, waiting = a, d, Automaton(), []
                elif d != doc:
                    for x in waiting:
                        automaton.add(x)
                    doc, waiting = d, []
                words = w.split(b" ")
                if found := standing(words, automaton):
                    rows.append((a, g, found))
                waiting.append(words)
            if rows:
                yield to_batch(rows, schema)

    ordered = cuts.select("anchor", "segment", "doc", "words").repartition("anchor").sortWithinPartitions("anchor", "doc")
    return ordered.mapInArrow(run, "anchor bigint, segment bigint, starts array<int>")


def cut_again(units: DataFrame, level: int) -> DataFrame:
    """k, s, owner (anchor and segment of the unit), doc, off, count, words: the segments of units under a higher level."""
    schema = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("off", pa.int32()), ("count", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(3).cast(pa.string())):
                n, h = hashed_words(texts)
                ends = np.cumsum(n)
                some = (batch.column(c).slice(at, len(texts)).to_pylist() for c in range(4))
                rows = []
                for anchor, segment, doc, words, a, b in zip(*some, (ends - n).tolist(), ends.tolist(), strict=True):
                    own = words.split(b" ")
                    for k, s, off, count in zip(*(x.tolist() for x in segments(h[a:b], level=level)), strict=True):
                        rows.append((np.uint64(k).view(np.int64), np.uint64(s).view(np.int64), anchor, segment, doc, off, count, b" ".join(own[off : off + count + WINDOW - 1])))
                if rows:
                    yield to_batch(rows, schema)

    return units.select("anchor", "segment", "doc", "words").mapInArrow(run, "k bigint, s bigint, anchor bigint, segment bigint, doc bigint, off int, count int, words binary")


def earlier_windows(cuts: DataFrame, level: int = 1) -> DataFrame:
    """anchor, segment, starts: the windows of distinct segments that stand in a segment of their anchor with a smaller doc. cuts: anchor, segment, doc, words, hot."""
    found = by_automata(cuts.where("not hot"))
    units = cuts.where("hot")
    if units.isEmpty():
        return found
    rows = stash(cut_again(units, 2 * level), "substring-again")
    one = rows.groupBy("k", "s").agg(F.min("doc").alias("doc"), F.max("doc").alias("hi"), F.min_by("words", "doc").alias("words"))
    per = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("k", "n")
    # at the last level all windows of an anchor are equal
    hot = F.lit(2 * level < WINDOW - GRAM + 1) & (F.col("n") > MAX_SEGMENTS)
    one = stash(one.join(per, "k").select(F.col("k").alias("anchor"), F.col("s").alias("segment"), "doc", "words", "hi", "n", hot.alias("hot")), "substring-units")
    deeper = earlier_windows(one.where("n > 1"), 2 * level)
    known = one.join(deeper, ["anchor", "segment"], "left").where("hi > doc or starts is not null").select(F.col("anchor").alias("k"), F.col("segment").alias("s"), F.col("doc").alias("least"), "starts")
    every = F.sequence(F.lit(0), F.col("count") - 1)
    hits = rows.join(known, ["k", "s"]).withColumn("own", F.when(F.col("doc") > F.col("least"), every).otherwise(F.col("starts"))).where("own is not null")
    again = hits.groupBy("anchor", "segment").agg(F.flatten(F.collect_list(F.transform("own", lambda i: (F.col("off") + i).cast("int")))).alias("starts"))
    return found.unionByName(stash(again, "substring-deeper"))


def covered(docs: DataFrame) -> DataFrame:
    """key, runs: of each document with something to remove, [first window, number of windows] that stand earlier."""
    segs = stash(all_segments(docs), "substring-segments")
    shared = stash(shared_segments(segs), "substring-shared")
    discard(segs)
    own = F.struct("doc", "key", "first", "count")
    distinct = stash(shared.groupBy("anchor", "segment").agg(F.min(own).alias("r"), F.max("doc").alias("hi")), "substring-distinct")
    per = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = distinct.join(per, "anchor").select("anchor", "segment", "r.doc", "r.key", "r.first", "r.count", (F.col("n") > MAX_SEGMENTS).alias("hot"))
    cuts = stash(cut(docs, wanted), "substring-cuts")
    earlier = stash(earlier_windows(cuts), "substring-earlier")
    discard(cuts)
    # all windows of a segment that stands whole in an earlier document; else those that the shards found
    known = distinct.join(earlier, ["anchor", "segment"], "left").select("anchor", "segment", F.col("r.doc").alias("least"), "hi", "starts").where("hi > least or starts is not null")
    known = stash(known, "substring-known")
    hits = shared.join(known, ["anchor", "segment"]).where("doc > least or starts is not null")
    whole = F.array(F.struct(F.col("first").alias("f"), F.col("count").alias("c")))
    some = F.transform("starts", lambda i: F.struct((F.col("first") + i).alias("f"), F.lit(1).alias("c")))
    runs = stash(hits.groupBy("key").agg(F.flatten(F.collect_set(F.when(F.col("doc") > F.col("least"), whole).otherwise(some))).alias("runs")), "substring-runs")
    discard(shared, distinct, earlier, known)
    return runs


def removed(n: int, runs: list | None) -> np.ndarray:
    """Which of n words the windows of runs cover."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edge[r["f"]] += 1
        edge[r["f"] + r["c"] + WINDOW - 1] -= 1
    return np.cumsum(edge)[:n] > 0


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def make(ids: list, texts: list, runs: list) -> Iterator[tuple]:
        for i, t, r in zip(ids, texts, runs, strict=True):
            words = words_of(t)
            gone = 0
            kept = words
            if r:
                mask = removed(len(words), r)
                gone = int(mask.sum())
                kept = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
            yield i, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()

    plain = keyed(docs, doc_id, text)
    rows = plain.join(covered(plain), "key", "left").select("doc_id", "text", "runs")
    return map_rows(rows, schema, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", make)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the passages removed from text, all other columns as they are.

    A text that loses nothing stays as it is; else its kept words keep the white space
    before them. A document that loses all of its words goes.
    """
    part = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+").findall

    def make(texts: list, runs: list) -> Iterator[str]:
        for t, r in zip(texts, runs, strict=True):
            parts = part(t)
            mask = removed(len(parts), r).tolist()
            yield "".join(p for p, x in zip(parts, mask, strict=True) if not x).lstrip("\x20\t\n\x0b\x0c\r")

    plain = keyed(docs, doc_id, text)
    key, runs, kept = unused(docs, "row_key", "runs", "kept")
    found = covered(plain).select(F.col("key").alias(key), F.col("runs").alias(runs))
    joined = docs.withColumn(key, row_key(doc_id, text)).join(found, key, "left")
    none = F.array().cast("array<struct<f:int,c:int>>")
    out = joined.withColumn(kept, F.when(F.col(runs).isNull(), F.col(text)).otherwise(_cut(make)(F.coalesce(F.col(text), F.lit("")), F.coalesce(runs, none))))
    gone = F.col(runs).isNotNull() & (F.col(kept) == "")
    return out.where(~gone).select(*[F.col(kept).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _cut(make: Callable[[list, list], Iterator[str]]) -> Callable[..., Column]:
    """make as a column function over Arrow batches."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array(make(texts.to_pylist(), runs.to_pylist()), pa.string())

    return run
