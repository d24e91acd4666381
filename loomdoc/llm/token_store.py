"""Token ids as a binary table with one shared zstandard dictionary.

Format: a table of blocks in ascending doc_id order. A block row holds
  part, block       place of the block: range partition, then number within it
  first_doc, last_doc  least and greatest doc_id of the block, so that a reader's filter skips blocks and row groups
  base              ids of the part's earlier blocks
  dictionary_hash   sha256 of the dictionary that its frames need
  width             bytes of an id (2 where the vocabulary allows, else 4; little-endian)
  doc_ids, offsets  the index: frame i is payload[offsets[i] : offsets[i + 1]]
  counts            ids of each document, the end id included
  payload           one zstandard frame for each document
so that a short document is read by one frame, without the others. The table lies in
any storage that Spark writes. A second table holds the dictionary.

Texts are cut at white space, which the tokenizer drops and no token crosses, some
megabytes of text at a time; each distinct pre-token of a piece is encoded once while it stays
in the worker's bounded memory, and documents are put together from their ids as whole columns.

Nulls: a null text is empty and gets the end id alone; null doc_ids come first. Rows
with the same doc_id stand by text. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, spread, text_slices

#: Pre-tokens a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: The dictionary: documents and ids of each that it is trained on, its bytes, the level of compression.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1000, 2048, 112_640, 3
BLOCK_BYTES = 4 << 20

#: Letters that are single code points under NFC, then ASCII signs without the apostrophe.
SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: The public byte-to-letter rule of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = dict(zip(_PLAIN, _PLAIN, strict=True)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}

BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()), T.StructField("base", T.LongType()),
    T.StructField("dictionary_hash", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType()),
])
BLOCKS_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("base", pa.int64()), ("dictionary_hash", pa.string()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def parts_simply(spec: dict) -> bool:
    """Whether a tokenizer file, by its own definition, lower-cases and then takes runs of letters and runs of signs (outside contractions) as pre-tokens in byte letters."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    normal, pre = normal.get("normalizers", []), pre.get("pretokenizers", [])
    if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
        return False
    blank, split, letters = normal[1], pre[0], pre[1]
    kinds = [x for x in split["pattern"].get("Regex", "").split("|") if not x.startswith("'")]
    return (
        blank["pattern"] == {"Regex": r"\s+"} and blank["content"] == " "
        and split["invert"] and split["behavior"] == "Removed" and kinds == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
        and not letters["add_prefix_space"] and not letters["use_regex"]
        and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout") and not spec["model"].get("continuing_subword_prefix")
    )


class Encoder:
    """Whole texts to packed ids; one for each worker and tokenizer file.

    White space parts a text into pieces. A piece of letters and then signs is two
    pre-tokens, which the model encodes; other pieces go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        # the model alone, on words that are mapped to its byte letters already; a word's last id is one with the word-end suffix
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        if suffix:
            self.is_end[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
        self.simple = bool(suffix) and parts_simply(json.loads(self.tok.to_str()))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def letters(word: str) -> str:
        return word.encode().decode("latin-1").translate(BYTE_LETTERS)

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """The packed ids of each text and the end id."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        length, ids = self.pieces(flat.dictionary)
        # the end id stands as one more piece behind each text
        length, ids = np.append(length, 1), np.append(ids, np.array([end], self.kind))
        start = np.cumsum(length) - length
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        codes = np.insert(flat.indices.to_numpy().astype(np.int64), ends, length.size - 1)
        raw = ids[spread(start[codes], length[codes])].tobytes()
        to = np.cumsum(np.concatenate([[0], length[codes]]))[ends + np.arange(1, ends.size + 1)] * self.width
        return [raw[a:b] for a, b in zip([0, *to.tolist()], to.tolist())]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of distinct pieces."""
        parts = pc.extract_regex(pieces, SIMPLE) if self.simple else pa.nulls(len(pieces), pa.struct([("letters", pa.string()), ("signs", pa.string())]))
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        whole = pieces.filter(parts.is_null()).to_pylist()
        own = pa.concat_arrays([pc.utf8_lower(pc.struct_field(parts, "letters")).drop_null(), pc.struct_field(parts, "signs").drop_null()]).dictionary_encode()
        packed = [*self.pre_tokens(own.dictionary.to_pylist()), *(self.pack(self.ids(p)) for p in whole)]
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        start = np.cumsum(length) - length
        # each piece is two entries: its letters and its signs, or itself and nothing
        first, second = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        n = int(simple.sum())
        first[simple], second[simple] = own.indices.to_numpy()[:n], own.indices.to_numpy()[n:]
        first[~simple] = len(own.dictionary) + np.arange(len(whole))
        second[~simple] = first[~simple]
        entries = np.stack([first, second], 1)
        lengths, starts = length[entries], start[entries]
        lengths[~simple, 1] = 0
        return lengths.sum(1), np.frombuffer(b"".join(packed), self.kind)[spread(starts.ravel(), lengths.ravel())]

    def pre_tokens(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct lower-case pre-tokens of letters or of signs."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None and w]
        merged = dict(zip(new, self.model_ids([self.letters(w) for w in new]), strict=True)) if new else {}
        merged[""] = b""
        if len(self.known) + len(merged) > REMEMBERED:
            self.known = {}
        self.known.update((w, x) for w, x in merged.items() if len(w) <= LONGEST)
        return [merged[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def model_ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in self.model.encode_batch_fast([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)], add_special_tokens=False):
            ids = np.asarray(some.ids, self.kind)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.is_end[ids]) + 1) * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train(docs: DataFrame, path: str, doc_id: str, text: str, end: int) -> bytes:
    """The shared dictionary, from packed ids of SAMPLE_DOCS documents, chosen by a hash of their doc_id (of one doc_id's texts the least); empty where that is too little.

    A document gives all its ids, or SAMPLE_IDS of them one after the other, from a place
    that a hash of its text gives. Tasks encode the whole texts; the driver gets the ids.
    """
    # the ids come from a scan of one column; then one filtered scan fetches at most SAMPLE_DOCS texts
    chosen = docs.select(F.col(doc_id).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(SAMPLE_DOCS)
    at = [r.i for r in chosen.collect()]
    if not at:
        return b""
    texts = docs.where(F.col(doc_id).isin(at)).groupBy(doc_id).agg(F.min(text).alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for _, some in text_slices(batch.column(0)):
                out = []
                for t, packed in zip(some.to_pylist(), enc.encode(some, end), strict=True):
                    spare = len(packed) // enc.width - SAMPLE_IDS
                    begin = zlib.crc32((t or "").encode()) % (spare + 1) * enc.width if spare > 0 else 0
                    out.append(packed[begin : begin + enc.width * SAMPLE_IDS])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in texts.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, end: int = 1, doc_id: str = "doc_id", text: str = "text", out: str | None = None) -> str:
    """Write the store of docs and return its folder. path: a tokenizers file at the same place on every machine."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train(docs, path, "doc_id", "text", end)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(mark, bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        made = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False)
        part, block, base, total = -1, 0, 0, 0
        ids: list = []
        counts: list = []
        frames: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = [part, block, next((i for i in ids if i is not None), None), ids[-1], base, mark, enc.width, ids, offsets, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS_ARROW, strict=True)], schema=BLOCKS_ARROW)

        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                some = (batch.column(c).slice(first, len(texts)).to_pylist() for c in (0, 1))
                for p, i, packed in zip(*some, enc.encode(texts, end), strict=True):
                    if frames and (size >= BLOCK_BYTES or p != part):
                        yield flush()
                        block, base, ids, counts, frames, size = block + 1, base + total, [], [], [], 0
                        total = 0
                    if p != part:
                        part, block, base, total = p, 0, 0, 0
                    frames.append(press.compress(packed))
                    ids.append(i)
                    counts.append(len(packed) // enc.width)
                    total += counts[-1]
                    size += len(frames[-1])
        if frames:
            yield flush()

    # the beginning of the text parts rows of one doc_id; row groups are small, so that few blocks share one
    ordered = docs.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    blocks = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, BLOCKS)
    blocks.write.option("parquet.block.size", BLOCK_BYTES).parquet(f"{out}/blocks")
    return out


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, as packed 4-byte ids, ids of every document of the store."""
    (row,) = spark.read.parquet(f"{store}/dictionary").collect()
    dictionary, mark = bytes(row.dictionary), row.dictionary_hash
    if hashlib.sha256(dictionary).hexdigest() != mark:
        raise ValueError("the dictionary is not the one that its hash names")
    shared = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dictionary_hash"] != mark:
                    raise ValueError("a block needs another dictionary")
                at, rows = b["base"], []
                for i, (doc, n) in enumerate(zip(b["doc_ids"], b["counts"], strict=True)):
                    packed = opener.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]], max_output_size=n * b["width"])
                    ids = packed if b["width"] == 4 else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                    rows.append((b["part"], doc, at, len(ids) // 4, zlib.crc32(ids), ids))
                    at += n
                for k in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 200], strict=True), schema, strict=True)], schema=schema)

    blocks = spark.read.schema(BLOCKS).parquet(f"{store}/blocks")
    # ids before each part: a running sum over one row for each range partition
    totals = blocks.select("part", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, at = [], 0
    for r in totals.orderBy("part").collect():  # as many rows as shuffle partitions
        before.append((r.part, at))
        at += r.n
    starts = spark.createDataFrame(before, "part int, before bigint")
    rows = blocks.mapInArrow(run, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")


def fetch(spark: SparkSession, store: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id, by their frames alone."""
    (row,) = spark.read.parquet(f"{store}/dictionary").collect()
    made = zstandard.ZstdCompressionDict(bytes(row.dictionary)) if row.dictionary else None
    opener = zstandard.ZstdDecompressor(dict_data=made)
    at = F.col("i")
    found = (
        spark.read.schema(BLOCKS).parquet(f"{store}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        .select("*", F.posexplode("doc_ids").alias("i", "d")).where(F.col("d") == doc_id)
        .select("width", F.col("counts")[at].alias("n"), F.expr("substring(payload, offsets[i] + 1, offsets[i + 1] - offsets[i])").alias("frame"))
    )
    return [list(struct.unpack(f"<{r.n}{'H' if r.width == 2 else 'I'}", opener.decompress(bytes(r.frame), max_output_size=r.n * r.width))) for r in found.collect()]
