"""Token counts by whole tokens.

Offline, on the driver, two things are proven from the vocabulary: where a text can
be cut without touching any merge, and which strings of the vocabulary encode alone
as one token. Pre-tokens among those strings count 1 without any merging; only the
rest is merged, each distinct one once while it stays in the worker's bounded memory.

The cut: a merge joins two neighbouring pieces into one of the vocabulary, so where no
piece holds two given neighbouring characters, no merge crosses between them, and what
stands left and right is encoded independently. That is checked for "anything but a
space, then a space" and for both sides of a line feed.

Nulls: a null text is empty: 0 bytes, 0 tokens. A null doc_id is kept. Repeated rows
give a row each. Very long texts are counted in blocks cut at such places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SPACE = "▁"
#: Distinct pre-tokens a worker remembers, and the longest it remembers.
REMEMBERED, LONGEST = 600_000, 64
BLOCK = 1 << 20


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def inner_counts(sp: sentencepiece.SentencePieceProcessor, parts: list[str]) -> list[int]:
    """Tokens of pre-tokens as they count inside a text, without the prefix that begins a text.

    They are encoded together, each after a line feed, which no merge crosses; parts hold no other line feed
    but may be one, which counts 1.
    """
    (mark,) = sp.encode("\n")[1:]
    out: list[int] = []
    for at in range(0, len(parts), 1000):
        some = parts[at : at + 1000]
        ids = np.asarray(sp.encode("\n" + "\n".join("" if p == "\n" else p for p in some) + "\n"), np.int32)
        ends = np.flatnonzero(ids == mark)
        out += [1 if p == "\n" else n for p, n in zip(some, (np.diff(ends) - 1).tolist(), strict=True)]
    return out


def prove(model: str) -> tuple[bool, list[str]]:
    """(texts can be cut before spaces and around line feeds, strings that encode alone as one token)."""
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    before_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
    line_feed = not any(len(p) > 1 and "\n" in p for p in pieces)
    # and the text is not normalised but for a prefix: spaces at any place stay as many pieces' worth of text
    kept = "".join(sp.encode(" a  \u00e9\u0065\u0301 \ufb01\tb ", out_type=str)).startswith(SPACE + SPACE + "a" + SPACE + SPACE)
    if not (before_space and line_feed and kept):
        return False, []
    surfaces = [p.replace(SPACE, " ") for p in pieces]
    return True, [s for s, n in zip(surfaces, inner_counts(sp, surfaces), strict=True) if n == 1]


class Counter:
    """Counts the tokens of texts; one for each worker and model."""

    def __init__(self, model: str, cuts: bool, whole: list[str]):
        self.sp = load(model)
        self.prefix = " " if self.sp.encode("a", out_type=str)[0].startswith(SPACE) else ""
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.cuts = cuts
        self.split = re.compile(r" *[^ \n]+|\n| +").findall
        self.cut = re.compile(r"(?<=[^ \n]) ").search

    def blocks(self, text: str) -> Iterator[str]:
        """The text in parts of about BLOCK characters, cut before a space that follows something else."""
        at = 0
        while len(text) - at > BLOCK and (m := self.cut(text, at + BLOCK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text))
        text = self.prefix + text.replace(SPACE, " ")
        return sum(map(self.count_block, self.blocks(text)))

    def count_block(self, block: str) -> int:
        parts = self.split(block)
        found = list(map(self.known.get, parts))
        if None not in found:
            return sum(found)
        rest = list({p for p, n in zip(parts, found, strict=True) if n is None})
        merged = dict(zip(rest, inner_counts(self.sp, rest), strict=True))
        n = sum(x if x is not None else merged[p] for p, x in zip(parts, found, strict=True))
        if len(self.known) + len(merged) > REMEMBERED:
            self.known = dict(self.whole)
        self.known.update((p, x) for p, x in merged.items() if len(p) <= LONGEST)
        return n


_counters: dict[str, Counter] = {}


def counter(model: str, proof: tuple[bool, list[str]]) -> Counter:
    """This worker's counter: it outlives the task, so later tasks find its memory warm."""
    if model not in _counters:
        _counters[model] = Counter(model, *proof)
    return _counters[model]


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. model: a sentencepiece BPE file at the same path on every machine."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(model))  # at most the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def make(ids: list, sizes: list, texts: list) -> Iterator[tuple]:
        c = counter(model, proof.value)
        for i, n, t in zip(ids, sizes, texts, strict=True):
            yield i, n, c.count(t)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), F.col(text))
    return map_rows(rows, schema, "doc_id bigint, n_bytes bigint, n_tokens bigint", make).withColumn("over_limit", F.col("n_tokens") > limit)
