"""Packed sequences against the library's ids of whole documents."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomdoc.llm import packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, length int, part string"


def documents() -> list[tuple]:
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.choice((1, 3, 40, 500, 4000))))) for i in range(40)]
    return [*rows, (3, rows[3][1]), (3, "other"), (None, "a b"), (90, None), (91, ""), (92, " \n\t"), (93, "x" * 20_000), (94, "<|endoftext|> ÉTÉ 日本語 😀 don't")]


def test_cuts():
    for longest in (1, 8, 2048):
        n = np.array([0, 1, 7, 8, 9, 2047, 2048, 2049, 10_000])
        owner, length = packing.cuts(n, longest)
        assert np.bincount(owner, weights=length, minlength=n.size).tolist() == n.tolist()
        for d in range(n.size):
            own = length[owner == d].tolist()
            assert own == sorted(own, reverse=True) and all(x & (x - 1) == 0 and x <= longest for x in own)
            short = [x for x in own if x < longest]
            assert len(short) == len(set(short))


@pytest.mark.parametrize("longest", [2048, 16])
def test_packing(spark, tmp_path, longest):
    tok = Tokenizer.from_file(WORD_BPE)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in documents()], DOCS).repartition(3)
    out = packing.write(docs, WORD_BPE, longest=longest, out=str(tmp_path / "packed"))
    rows = packing.read(spark, out).collect()
    want = collections.Counter()
    for i, t in documents():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        (_, length), at = packing.cuts(np.array([len(ids)]), longest), 0
        for n in length.tolist():
            raw = np.asarray(ids[at : at + n], "<u4").tobytes()
            want[i, at, n, zlib.crc32(raw), len(ids), raw] += 1
            at += n
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in rows) == want
    # sequences number without gaps, bucket by bucket, one piece each
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(rows))) and all(r.offset == 0 for r in rows)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    bucket = spark.read.parquet(f"{out}/length={longest}")
    assert bucket.where(F.length("ids") != longest * F.col("width")).count() == 0 and bucket.count() == sum(r.length == longest for r in rows)


def test_no_documents(spark, tmp_path):
    out = packing.write(spark.createDataFrame([], DOCS), WORD_BPE, out=str(tmp_path / "none"))
    assert packing.read(spark, out).count() == 0
    with pytest.raises(ValueError):
        packing.write(spark.createDataFrame([], DOCS), WORD_BPE, longest=1000)
