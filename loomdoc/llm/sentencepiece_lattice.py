"""SentencePiece encoding and decoding of whole documents by a relational lattice.

A text is a chain of words: a line feed, or a run of characters with the spaces before
it, which ends where a sign follows a Latin letter, and in long runs wherever two neighbours
stand together in no piece. So no piece crosses a cut, words are encoded by themselves, and
each distinct word once: its substrings of bounded length are exploded and joined to the
piece table; the matches, and single characters that are no piece, are the edges of the
word's lattice, grouped by word and folded to ids. Edges carry 128 bits in place of their
word, and long words are exploded in overlapping blocks.

Two rules fold a lattice. "merges" is that of a BPE file: of all neighbours that join to
an edge the pair with the best score is joined, the left one of equals, until none is
left. "score" is that of a unigram file: the path of the greatest sum of scores (Viterbi
in a higher-order aggregate); of equal scores the path with the shorter last piece stays.

documents() then puts the ids of every document together, in order, decodes them and
compares the text. The FREQUENT most frequent short words go to the workers (bounded by
their number and length); all others of a document meet their ids by shuffles. Texts are
taken apart and put together as whole columns, some megabytes of text at a time.

Nulls: a null text is empty and has no words; it stays with no ids. A null doc_id is
kept. Rows with the same doc_id and text get equal rows. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, row_key, spread, stash, text_slices, tidy, unpacked

SPACE = "▁"
SIGN = SPACE.encode()
LETTER = "[A-Za-zÀ-ɏ]"
#: Words that every worker holds, at most, and the longest of them.
FREQUENT, LONGEST = 300_000, 64
#: What a character that is no piece loses against the least score, as the library has it.
PENALTY = 10.0
#: Distinct runs that a task counts at a time.
COUNTED = 500_000
#: In a packed edge: a character that is no piece.
NO_PIECE = (1 << 24) - 1
#: How a seldom word's place among those of its document is packed: in bytes that sort as the places do.
PLACE = np.dtype(">u4")
#: Bytes of text that are taken apart at a time: the frequent words are looked up once for all of them.
TAKEN = 3 << 19
#: Words above LONG characters are cut between any neighbours that no piece holds; words are exploded BLOCK characters at a time.
LONG, BLOCK = 64, 256
#: The longest word that is merged together with others.
TOGETHER = 40
#: In texts taken apart: each space after the first of several, and a cut. Texts that hold them go another way.
MORE, CUT = "\x01", "\x02"


def pieces(spark: SparkSession, model: str) -> tuple[DataFrame, int, float, int]:
    """(piece, id, score; the longest piece; the least score; the id of byte 0)."""
    sp, rows = vocabulary(model)
    # from Arrow: rows of Python objects would start workers of another kind, which stay beside those of the operator
    piece, i, score = zip(*rows, strict=True)
    table = spark.createDataFrame(pa.table({"piece": pa.array(piece, pa.string()), "id": pa.array(i, pa.int32()), "score": pa.array(score, pa.float64())}))
    return table, max(len(p) for p, _, _ in rows), min(s for _, _, s in rows), sp.piece_to_id("<0x00>")


def vocabulary(model: str) -> tuple[sentencepiece.SentencePieceProcessor, list[tuple[str, int, float]]]:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or len(p) > 1 and "\n" in p for p, _, _ in rows):
        raise ValueError("pieces of this vocabulary cross words")
    return sp, rows


class Cuts:
    """Where texts are cut into words; of a worker and a vocabulary."""

    def __init__(self, model: str):
        self.pairs = {(a + b).replace(SPACE, " ") for piece, _, _ in vocabulary(model)[1] for a, b in itertools.pairwise(piece)}
        #: signs that no piece holds after a Latin letter
        signs = "".join("\\" + c for c in string.punctuation if not any(b == c and re.match(LETTER, a) for a, b in self.pairs))
        self.signs = f"({LETTER})([{signs}])" if signs else None
        self.words = re.compile(f" *(?:[^ \\n]*?{LETTER}(?=[{signs}])|[^ \\n]+)|\\n| +" if signs else " *[^ \\n]+|\\n| +").findall

    def finer(self, word: str) -> list[str]:
        """A long word cut between any neighbours that no piece holds."""
        if len(word) <= LONG:
            return [word]
        at = [0, *(i for i, pair in enumerate(itertools.pairwise(word), 1) if pair[0] + pair[1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(at)]

    def of(self, run: str) -> list[str]:
        return [w for word in self.words(run) for w in self.finer(word)]


#: Runs of a text, which are cut into words.
runs = re.compile(" *[^ \n]+|\n| +").findall


def prefixed(text: str) -> str:
    """The text as the library reads it: with a space before it, and its own sign for spaces is one."""
    return " " + text.replace(SPACE, " ")


def coded_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of runs of each text, the code of each run in order, the runs by code).

    A run is written without the space before it, with MORE for each further one; or as
    a line feed and what follows it; or, in texts that hold MORE or CUT, as two line feeds and itself.
    """
    y = pc.binary_join_element_wise(" ", pc.replace_substring(pc.fill_null(texts, ""), SPACE, " "), "")
    if pc.any(pc.match_substring_regex(y, f"[{MORE}{CUT}]")).as_py():
        lists = [["\n\n" + r for r in runs(prefixed(t))] if t else [] for t in texts.to_pylist()]
        flat = pa.array(itertools.chain.from_iterable(lists), pa.string()).dictionary_encode()
        return np.array([len(x) for x in lists], np.int64), flat.indices.to_numpy().astype(np.int64), flat.dictionary
    y = pc.replace_substring(pc.replace_substring(y, "  ", " " + MORE), MORE + " ", MORE + MORE)
    lists = pc.split_pattern(pc.replace_substring(y, "\n", " \n"), " ")
    flat = lists.flatten().dictionary_encode()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    kept = np.ones(len(flat), bool)
    kept[np.cumsum(counts) - counts] = False  # nothing stands before the first space
    empty = pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
    kept[(np.cumsum(counts) - 1)[empty]] = False
    return np.where(empty, 0, counts - 1), flat.indices.to_numpy()[kept].astype(np.int64), flat.dictionary


def words_of_runs(coded: pa.Array, cuts: Cuts) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each run, the words in order)."""
    feed = pc.starts_with(coded, "\n")
    if pc.any(pc.starts_with(coded, "\n\n")).as_py():
        lists = [cuts.of(r[2:]) for r in coded.to_pylist()]
        return np.array([len(x) for x in lists], np.int64), pa.array(itertools.chain.from_iterable(lists), pa.string())
    spaced = pc.binary_join_element_wise(" ", pc.replace_substring(coded, MORE, " "), "")
    a = pc.if_else(feed, pc.replace_substring(coded, "\n", "\n" + CUT), spaced)
    if cuts.signs:
        a = pc.replace_substring_regex(a, cuts.signs, "\\1" + CUT + "\\2")
    lists = pc.split_pattern(a, CUT)
    flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    filled = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(counts.size), counts)[filled.to_numpy(zero_copy_only=False)]
    flat = flat.filter(filled)
    if (pc.max(pc.utf8_length(flat)).as_py() or 0) > LONG:
        finer = [cuts.finer(w) for w in flat.to_pylist()]
        owner = np.repeat(owner, [len(x) for x in finer])
        flat = pa.array(itertools.chain.from_iterable(finer), pa.string())
    return np.bincount(owner, minlength=counts.size), flat


def summed(arrays: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of the arrays and the sums of their counts."""
    d = pa.concat_arrays(arrays).dictionary_encode()
    return d.dictionary, np.bincount(d.indices.to_numpy(), np.concatenate(counts), len(d.dictionary)).astype(np.int64)


def count_words(docs: DataFrame, model: str, text: str) -> DataFrame:
    """word, times: the words of all texts; each task counts a bounded number at a time, so a word has a row for some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(model)
        held: list[pa.Array] = []
        counts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                coded, n = summed(held, counts)
                per, words = words_of_runs(coded, cuts)
                words, n = summed([words], [np.repeat(n, per)])
                held.clear()
                counts.clear()
                tidy()
                for at in range(0, len(words), 20_000):
                    yield pa.RecordBatch.from_arrays([words.slice(at, 20_000), pa.array(n[at : at + 20_000])], names=["word", "times"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                _, code, coded = coded_runs(texts)
                held.append(coded)
                counts.append(np.bincount(code, minlength=len(coded)))
                if sum(map(len, held)) > 2 * COUNTED:
                    coded, n = summed(held, counts)
                    held[:], counts[:] = [coded], [n]
                    if len(coded) > COUNTED:
                        yield from flush()
        yield from flush()

    return docs.select(F.col(text)).mapInArrow(run, "word string, times bigint").where("times > 0")


def distinct_words(counted: DataFrame) -> DataFrame:
    """h, g, word, times: each word once; h and g are 64-bit hashes of it, and its rows lie by h."""
    once = counted.repartition(F.xxhash64("word")).select(F.xxhash64("word").alias("h"), "word", "times").groupBy("h", "word").agg(F.sum("times").alias("times"))
    return once.select("h", F.xxhash64(F.lit("lattice"), "word").alias("g"), "word", "times")


def edges(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """h, g, s, len, part, id, score: the lattice of every word; id and score are null where a character is no piece. word and times stand in its first edge alone."""
    w = F.translate("word", " ", SPACE)
    n = F.length("word")
    blocks = words.select("h", "g", "word", "times", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).alias("b"))
    blocks = blocks.select("h", "g", "word", "times", "n", (F.col("b") * BLOCK).alias("at"), F.when(F.col("n") <= BLOCK, w).otherwise(F.substring(w, F.col("b") * BLOCK + 1, F.lit(BLOCK + longest - 1))).alias("w"))
    starts = blocks.select("h", "g", "word", "times", "n", "at", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.col("n") - F.col("at")))).alias("k"))
    parts = starts.select("h", "g", "word", "times", "at", "k", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("at") - F.col("k") + 1))).alias("len"))
    first = (F.col("at") + F.col("k") == 1) & (F.col("len") == 1)
    parts = parts.select("h", "g", F.when(first, F.col("word")).alias("word"), F.when(first, F.col("times")).alias("times"), (F.col("at") + F.col("k")).alias("s"), "len", F.expr("substring(w, k, len)").alias("part"))
    return parts.join(F.broadcast(table), F.col("part") == F.col("piece"), "left").where("id is not null or len = 1")


def scored(found: DataFrame, least: float, byte0: int) -> DataFrame:
    """h, g, word, times, e (end, len, score, ids) of edges."""
    code = F.hex(F.encode("part", "UTF-8"))
    raw = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + byte0)
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(raw)
    score = F.coalesce("score", F.lit(least - PENALTY))
    return found.select("h", "g", "word", "times", F.struct((F.col("s") + F.col("len") - 1).alias("end"), "len", score.alias("score"), ids.alias("ids")).alias("e"))


def viterbi(lattice: Column, longest: int) -> Column:
    """The ids of the best path over edges sorted by (end, len); every end has an edge of length 1, which opens it.

    State: of the last `longest` places and the one before them, the best score and the ids of its path.
    """
    none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, e: Column) -> Column:
        opens = e["len"] == 1
        before = F.element_at(acc, F.when(opens, F.lit(-1)).otherwise(-1 - e["len"]))
        total = before["score"] + e["score"]
        entry = F.struct(total.alias("score"), F.concat(before["ids"], e["ids"]).alias("ids"))
        opened = F.array_append(F.when(F.size(acc) > longest, F.slice(acc, -longest, longest)).otherwise(acc), entry)
        better = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), entry)
        return F.when(opens, opened).when(total > F.element_at(acc, -1)["score"], better).otherwise(acc)

    return F.aggregate(lattice, F.array(none), step, lambda acc: F.element_at(acc, -1)["ids"])


def merge(word: str, lattice: list[int], order: list[int], byte0: int) -> list[int]:
    """The ids of a word by merges. lattice: packed edges, (start << 32) + (length << 24) + id; order: the place of each id by score."""
    at = {e >> 24: e & NO_PIECE for e in lattice}  # (start << 8) + length -> id
    none = len(order)
    n = len(word)
    ends = list(range(1, n + 1)) + [0]  # by start of a part: its end
    before = list(range(-1, n))  # by start of a part: the start of the part before it
    heap = []

    def offer(a: int, b: int) -> None:
        i = at.get((a << 8) + ends[b] - a, NO_PIECE) if ends[b] - a < 256 else NO_PIECE
        if i != NO_PIECE and order[i] < none:
            heap.append((order[i], a, b, ends[b])) if not ready else heapq.heappush(heap, (order[i], a, b, ends[b]))

    ready = False
    for a in range(n - 1):
        offer(a, a + 1)
    heapq.heapify(heap)
    ready = True
    gone = bytearray(n)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if gone[a] or gone[b] or ends[a] != b or ends[b] != end:
            continue
        ends[a], gone[b] = end, 1
        if end < n:
            before[end] = a
            offer(a, end)
        if a:
            offer(before[a], a)
    out, a = [], 0
    while a < n:
        i = at[(a << 8) + ends[a] - a]
        out += [i] if i != NO_PIECE else [byte0 + x for x in word[a].encode()]
        a = ends[a]
    return out


def merge_together(n: np.ndarray, counts: np.ndarray, e: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids, ids) of words by merges, all in step. n: their lengths; counts: how many of the packed edges e each has."""
    size, none = int(n.max()), np.iinfo(np.int32).max
    start, length, i = e >> 32, (e >> 24) & 255, e & NO_PIECE
    most, word = int(length.max()), np.repeat(np.arange(n.size), counts)
    piece = np.full((n.size, size + 1, most + 1), NO_PIECE, np.int32)
    piece[word, start, length] = i
    place = np.full(piece.shape, none, np.int32)
    place[word, start, length] = np.where(i == NO_PIECE, none, order[np.where(i == NO_PIECE, 0, i)])
    part = np.arange(size)[None, :] < n[:, None]
    end = np.tile(np.arange(1, size + 1), (n.size, 1))
    before = np.tile(np.arange(-1, size), (n.size, 1))
    offers = place[:, :size, 2].copy() if most > 1 else np.full((n.size, size), none, np.int32)

    def offer(w: np.ndarray, a: np.ndarray, to: np.ndarray) -> None:
        offers[w, a] = np.where(to - a <= most, place[w, a, np.minimum(to - a, most)], none)

    every = np.arange(n.size)
    while True:
        a = offers.argmin(1)
        w = np.flatnonzero(offers[every, a] < none)
        if not w.size:
            break
        a = a[w]
        b = end[w, a]
        to = end[w, b]
        end[w, a], part[w, b], offers[w, b], offers[w, a] = to, False, none, none
        more = to < n[w]
        before[w[more], to[more]] = a[more]
        offer(w[more], a[more], end[w[more], to[more]])
        p = before[w, a]
        some = p >= 0
        offer(w[some], p[some], to[some])
    w, a = np.nonzero(part)
    return part.sum(1), piece[w, a, end[w, a] - a]


def fold_by_merges(words: list[str], lattices: pa.Array, order: np.ndarray, byte0: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids, ids) of each word: short words together, those that are long or hold a character that is no piece one by one."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    e, counts = lattices.flatten().to_numpy(), np.diff(lattices.offsets.to_numpy()).astype(np.int64)
    first = np.cumsum(counts) - counts
    odd = np.zeros(n.size, bool)
    odd[np.repeat(np.arange(n.size), counts)[(e & NO_PIECE) == NO_PIECE]] = True
    odd |= n > TOGETHER
    lengths, pools, starts, at = np.zeros(n.size, np.int64), [np.empty(0, np.int64)], np.zeros(n.size, np.int64), 0
    alike = np.flatnonzero(~odd)
    alike = alike[np.argsort(n[alike], kind="stable")]
    for k in range(0, alike.size, 2000):
        some = alike[k : k + 2000]
        lengths[some], ids = merge_together(n[some], counts[some], e[spread(first[some], counts[some])], order)
        starts[some] = at + np.cumsum(lengths[some]) - lengths[some]
        at += ids.size
        pools.append(ids)
    slow = order.tolist() if odd.any() else []
    for k in np.flatnonzero(odd).tolist():
        ids = np.array(merge(words[k], e[first[k] : first[k] + counts[k]].tolist(), slow, byte0), np.int64)
        lengths[k], starts[k] = ids.size, at
        at += ids.size
        pools.append(ids)
    return lengths, np.concatenate(pools)[spread(starts, lengths)]


def int_lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int32()))


def id_type(model: str) -> np.dtype:
    """What the ids of a vocabulary are packed as: two bytes each, where that holds them."""
    return np.dtype("<u2" if vocabulary(model)[0].vocab_size() <= 1 << 16 else "<u4")


def packed_lists(lengths: np.ndarray, values: np.ndarray, kind: np.dtype) -> pa.Array:
    """Lists of numbers as binary values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), lengths.size, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(kind))])


def lexicon(counted: DataFrame, model: str, rule: str) -> DataFrame:
    """word, n, ids (packed) for each distinct word of n occurrences. counted: word, times, with any number of rows a word."""
    spark = counted.sparkSession
    table, longest, least, byte0 = pieces(spark, model)
    kind = id_type(model)
    found = edges(distinct_words(counted), table, longest)
    own = (F.max("word").alias("word"), F.max("times").alias("n"))
    if rule == "score":
        grouped = scored(found, least, byte0).groupBy("h", "g").agg(*own, F.array_sort(F.collect_list("e")).alias("lattice"))
        paths = grouped.select("word", "n", viterbi(F.col("lattice"), longest).alias("ids"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(2)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed_lists(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), kind)], names=["word", "n", "ids"])

        return paths.mapInArrow(pack, "word string, n bigint, ids binary")
    if rule != "merges" or longest > 255:
        raise ValueError("no such rule for this file")
    packed = F.shiftleft((F.col("s") - 1).cast("bigint"), 32) + F.shiftleft(F.col("len").cast("bigint"), 24) + F.coalesce("id", F.lit(NO_PIECE))
    grouped = found.select("h", "g", "word", "times", packed.alias("e")).groupBy("h", "g").agg(*own, F.collect_list("e").alias("lattice")).select("word", "n", "lattice")
    scores = {i: s for _, i, s in vocabulary(model)[1]}
    place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    order = np.array([place[scores[i]] if i in scores else len(scores) for i in range(max(scores) + 1)], np.int32)
    shared = spark.sparkContext.broadcast(order)  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed_lists(*fold_by_merges(b.column(0).to_pylist(), b.column(2), shared.value, byte0), kind)], names=["word", "n", "ids"])

    return grouped.mapInArrow(run, "word string, n bigint, ids binary")


class Decoder:
    """The pieces of ids as bytes, looked up and joined."""

    def __init__(self, model: str):
        sp, rows = vocabulary(model)
        byte0 = sp.piece_to_id("<0x00>")
        own = [b""] * sp.vocab_size()
        for p, i, _ in rows:
            own[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            own[byte0 + b] = bytes([b])
        self.length = np.array([len(x) for x in own], np.int64)
        self.start, self.pool = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(own), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        some = (ids[at : at + 100_000] for at in range(0, ids.size, 100_000))
        return b"".join([self.pool[spread(self.start[x], self.length[x])].tobytes() for x in some])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that was put before it."""
        return self.bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]


def raw_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each value begins and the last one ends, the bytes) of a column of strings or binary values without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data or b"", np.uint8)


def unpacked_lists(column: pa.Array, kind: np.dtype, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids, ids) of binary values, which have so many bytes before the ids."""
    at, raw = raw_values(column)
    lengths, raw = np.diff(at), raw[at[0] : at[-1]]
    if head:
        raw = raw[spread(np.cumsum(lengths) - lengths + head, lengths - head)]
    return (lengths - head) // kind.itemsize, raw.view(kind).astype(np.int32)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, equal in every process: polynomials of their bytes."""
    at, raw = raw_values(words)
    lengths = np.diff(at)
    if not lengths.sum():
        return np.zeros(lengths.size, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        terms = powers[spread(np.zeros(lengths.size, np.int64), lengths)] * (raw[at[0] : at[-1]] + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        h = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
        return h ^ (h >> np.uint64(32))


class Frequent:
    """The most frequent words and their ids, by the words' hashes; of words of one hash the first stays."""

    def __init__(self, table: pa.Table, kind: np.dtype):
        words = table.column("word").combine_chunks()
        self.hash, first = np.unique(word_hashes(words), return_index=True)
        self.words = words.take(pa.array(first))
        length, self.pool = unpacked_lists(table.column("ids").combine_chunks().take(pa.array(first)), kind)
        #: by place; the last is that of a word that is not here
        self.length = np.append(length, 0)
        self.start = np.cumsum(self.length) - self.length

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the frequent ones, or -1."""
        if not self.hash.size:
            return np.full(len(words), -1, np.int64)
        h = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hash, h), self.hash.size - 1)
        some = np.flatnonzero(self.hash[at] == h)
        same = pc.equal(words.take(pa.array(some)), self.words.take(pa.array(at[some]))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1, np.int64)
        out[some[same]] = at[some[same]]
        return out


def frequent_words(lex: DataFrame, kind: np.dtype) -> Frequent:
    """Of words up to LONGEST characters the most frequent, FREQUENT at most: the driver first reads how many have which frequency, in bands."""
    band = F.floor(F.log2("n") * 16)
    short = lex.where(F.length("word") <= LONGEST)
    total, lowest = 0, None
    for r in sorted(short.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.band):
        total += r.c
        if total > FREQUENT:
            break
        lowest = r.band
    return Frequent(short.where(F.lit(lowest is not None) & (band >= F.lit(lowest or 0))).select("word", "ids").toArrow(), kind)


class Taken:
    """Texts taken apart: the words of each in order, and which of them are not among the frequent ones."""

    def __init__(self, texts: pa.Array, cuts: Cuts, frequent: Frequent):
        n_runs, code, coded = coded_runs(texts)
        per, words = words_of_runs(coded, cuts)
        own = words.dictionary_encode()
        first = np.cumsum(per) - per
        self.distinct = own.dictionary
        #: the code of each word in order, and the texts' numbers of words
        self.words = own.indices.to_numpy().astype(np.int64)[spread(first[code], per[code])]
        ends = np.cumsum(np.concatenate([[0], per[code]]))[np.cumsum(n_runs)]
        self.n_words = np.diff(np.concatenate([[0], ends]))
        known = frequent.places(self.distinct)
        #: each word's place among the frequent ones, or -1
        self.known = known[self.words]
        seldom = np.flatnonzero(self.known < 0)
        owner = np.repeat(np.arange(len(texts)), self.n_words)[seldom]
        code, first, again = np.unique(owner * (len(self.distinct) + 1) + self.words[seldom], return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        #: distinct seldom words, text by text, in order of their first places: the text's number, the word's code; and which of them each seldom word is
        self.owner, self.word, self.which = code[order] // (len(self.distinct) + 1), code[order] % (len(self.distinct) + 1), rank[again]


def documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", rule: str = "merges", order: str | None = None) -> DataFrame:
    """doc_id, key, n_words, n_tokens, ids, exact, restored of each row of docs, and position: the bigint column that order names, or null.

    ids: of the whole document, in order. Its ids are decoded again: restored says whether that is the text,
    exact whether it is the text with U+2581 read as a space, which is what the library encodes.
    """
    spark, kind = docs.sparkSession, id_type(model)
    lex = stash(lexicon(count_words(docs, model, text), model, rule), "lattice-lexicon")
    frequent = spark.sparkContext.broadcast(frequent_words(lex, kind))
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"), (F.col(order) if order else F.lit(None)).cast("bigint").alias("position"))
    keyed = keyed.withColumn("h", F.xxhash64("key"))

    def seldom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(model)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), TAKEN):
                t = Taken(texts, cuts, frequent.value)
                place = np.arange(t.owner.size) - np.searchsorted(t.owner, t.owner)  # owners ascend
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at).take(pa.array(t.owner)), packed_lists(np.ones(place.size, np.int64), place, PLACE), t.distinct.take(pa.array(t.word))], names=["h", "k", "word"])

    rare = keyed.select("h", "text").mapInArrow(seldom, "h bigint, k binary, word string")
    rare = stash(rare.join(lex.select("word", "ids"), "word").select("h", F.concat("k", "ids").alias("x")), "lattice-seldom")
    discard(lex)
    # equal rows have equal seldom words; each place, which stands before the ids, counts once. Rows of one h that are not equal
    # would have more places than words, which assemble() refuses
    per = rare.repartition("h").groupBy("h").agg(F.array_sort(F.collect_set("x")).alias("rare"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at, texts in text_slices(batch.column(4), TAKEN):
                frames = pa.array([z.compress(t) if t else None for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:4]), frames], names=["h", "key", "doc_id", "position", "z"])

    squeezed = keyed.select("h", "key", "doc_id", "position", "text").mapInArrow(squeeze, "h bigint, key binary, doc_id bigint, position bigint, z binary")
    names = ["doc_id", "key", "position", "n_words", "n_tokens", "ids", "exact", "restored"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, decoder, common = Cuts(model), Decoder(model), frequent.value

        def put_together(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            t = Taken(texts, cuts, common)
            rare = rows.column(4)
            lists = rare.flatten()
            if not np.array_equal(pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False), np.bincount(t.owner, minlength=len(texts))):
                raise ValueError("the seldom words of a document are not those that were looked up")
            length, own_ids = unpacked_lists(lists, kind, PLACE.itemsize)
            pool = np.concatenate([common.pool, own_ids])
            start = np.cumsum(length) - length + common.pool.size
            lengths, starts = common.length[t.known], common.start[t.known]
            rest = t.known < 0
            lengths[rest], starts[rest] = length[t.which], start[t.which]
            ids = pool[spread(starts, lengths)]
            of = lambda n, x: np.diff(np.concatenate([[0], np.cumsum(np.concatenate([[0], x]))[np.cumsum(n)]]))
            n_tokens = of(t.n_words, lengths)
            back, ends = decoder.bytes(ids), np.cumsum(of(n_tokens, decoder.length[ids])).tolist()
            own = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
            read = [x.replace(SIGN, b" ") for x in own]
            exact = [back[a + 1 : b] == x for a, b, x in zip([0, *ends], ends, read)]
            restored = [e and x == y for e, x, y in zip(exact, own, read, strict=True)]
            return pa.RecordBatch.from_arrays([rows.column(1), rows.column(0), rows.column(2), pa.array(t.n_words), pa.array(n_tokens), int_lists(n_tokens, ids), pa.array(exact), pa.array(restored)], names=names)

        for batch in batches:
            for at, texts in unpacked(batch.column(3), TAKEN):
                yield put_together(batch.slice(at, len(texts)), texts)

    return squeezed.join(per, "h", "left").select("key", "doc_id", "position", "z", "rare").mapInArrow(assemble, "doc_id bigint, key binary, position bigint, n_words bigint, n_tokens bigint, ids array<int>, exact boolean, restored boolean")


def ids_of(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", rule: str = "score") -> DataFrame:
    """doc_id, key, ids: the ids of each document that has a word, in order; rows with the same doc_id and text give one."""
    return documents(docs, model, doc_id, text, rule).where("n_words > 0").select("doc_id", "key", "ids").dropDuplicates(["key"])


def decode(rows: DataFrame, model: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """key, text of each row of ids: the ids' pieces, looked up in the piece table, joined in order, without the prefix space."""

    def make(keys: list, lists: list) -> Iterator[tuple]:
        decoder = Decoder(model)
        for k, i in zip(keys, lists, strict=True):
            yield k, decoder.decode(i)

    return map_rows(rows.select(F.col(key).cast("binary"), ids), pa.schema([("key", pa.binary()), ("text", pa.string())]), "key binary, text string", make)


def digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", rule: str = "merges") -> DataFrame:
    """doc_id, n_words, n_tokens, ids, exact, restored of each row of docs: documents() without its key."""
    return documents(docs, model, doc_id, text, rule).drop("key", "position")
