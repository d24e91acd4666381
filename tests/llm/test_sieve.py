"""Bits in place of keys, and pairs of small buckets: what they leave out is nothing that counts, and what they save is not shuffled."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import common, ngram_join


def test_bits_tell_which_rows_are_among(spark):
    ids = [0, 1, -1, 5, 32768, 32769, 65536, (3 << 33) + 7, -(1 << 40), 2**63 - 1]
    rows = spark.createDataFrame([(i, "t") for i in {*ids, 2, 3, -2, 32767, 65535, (3 << 33) + 8, 1 << 40, None}], "id bigint, own string")
    got = common.among(rows, spark.createDataFrame([(i,) for i in [*ids, 5, None]], "id bigint"))
    assert got.columns == ["id", "own"] and sorted(r.id for r in got.collect()) == sorted(ids)
    assert common.among(rows, rows.where("false")).count() == 0


def test_a_sieve_lets_all_its_keys_through(spark, monkeypatch):
    keys = common.stash(spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k")), "keys")
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"), "id", F.lit(1).alias("bits"), F.lit(2).alias("own"))
    for most in (1 << 28, 64):
        monkeypatch.setattr(common, "MOST_BITS", most)
        bits, place = common.sieve(keys, "k")
        got = common.flagged(rows, place, bits, "maybe").where("maybe")
        found = {r.id for r in got.collect()}
        assert found >= set(range(500)) and (most == 64 or len(found) < 1000) and got.columns == [*rows.columns, "maybe"]


def test_texts_of_one_document_are_not_shuffled(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 390).cast("string")).alias("text"))
    least = ngram_join.least(ngram_join.keyed(docs, "doc_id", "text")).collect()
    assert sorted(r.class_id for r in least) == list(range(390))
    kept = ngram_join.first_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(390))
    # a part of the rows reaches the result without any shuffle, what a sieve lets through after a join
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("LeftSemi") == 1 and "LeftSemi" not in plan.split("\n+- ")[0]


def sets(r: random.Random, many: int) -> list[np.ndarray]:
    out = []
    for g in range(many):
        base = [r.getrandbits(63) for _ in range(r.choice((1, 4, 30, 90)))]
        for _ in range(r.choice((1, 2, 5))):
            s = {*(x for x in base if r.random() > r.choice((0, 0.02, 0.1, 0.3))), *(r.getrandbits(63) for _ in range(r.choice((0, 1, 8)))), *(range(1, 4) if r.random() < 0.3 else ())}
            out.append(np.array(sorted(s), np.uint64))
    return [s for s in out if s.size]


@pytest.mark.parametrize("few", [2, 32])
def test_pairs_of_small_buckets_lose_no_similar_ones(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    r, none = random.Random(few), np.empty(0, np.uint64)
    nodes = sets(r, 60)
    tokens = collections.defaultdict(set)
    for i, s in enumerate(nodes):
        for t in np.concatenate(ngram_join.prefix(s, 0, none)).tolist():
            tokens[t].add(i)
    b = spark.createDataFrame([(t, i) for t, own in tokens.items() for i in own], "token bigint, id bigint")
    n = spark.createDataFrame([(i, s.size) for i, s in enumerate(nodes)], "id bigint, n bigint")
    rows = ngram_join.kinds(b, n).withColumn("root", F.col("id"))
    pairs, more = ngram_join.of_few(rows)
    got = {(x.leader, x.id) for x in pairs.collect()}
    large = collections.defaultdict(set)
    for x in more.collect():
        large[x.token].add(x.id)
    assert all(len(x) > few for x in large.values())
    similar = [(i, k) for i, k in itertools.combinations(range(len(nodes)), 2) if 100 * (c := np.intersect1d(nodes[i], nodes[k]).size) >= 80 * (nodes[i].size + nodes[k].size - c)]
    assert len(similar) > 20 and all(p in got or any({*p} <= x for x in large.values()) for p in similar)
    # of pairs that share a token, those that share too few are gone
    met = {p for own in tokens.values() for p in itertools.combinations(sorted(own), 2)}
    assert len(got) < len(met) or few == 2
    sizes = [(i, k, int(ngram_join.required(i, k))) for i in range(1, 60) for k in range(1, 60)]
    made = spark.createDataFrame(sizes, "a bigint, b bigint, r bigint").where(ngram_join.needed("a", "b") != F.col("r"))
    assert made.count() == 0
