"""Hybrid search against plain scoring, container sections, second extractions of stale elements."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import containers, hybrid, kg


def plain(docs, queries, k):
    bags = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    df = collections.Counter(w for b in bags.values() for w in set(b))
    out = {}
    for q, words in queries:
        score = collections.Counter()
        for i, b in bags.items():
            for w in set(words) & set(b):
                tf = b.count(w)
                r = tf * (hybrid.K1 + 1) / (tf + hybrid.K1 * (1 - hybrid.B + hybrid.B * len(b) / mean))
                score[i] += math.floor(hybrid.UNIT * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * r)
        out[q] = sorted(((-s, i) for i, s in score.items() if s > 0))[:k]
    return out


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bands_lose_nothing(spark, tmp_path, k):
    r = random.Random(k)
    words = [f"w{min(int(r.expovariate(0.15)), 60)}" for _ in range(400)]
    docs = [(i, " ".join(r.choices(words, k=r.choice((3, 20, 120))))) for i in range(300)] + [(300, None), (301, ""), (302, "w0 " * 50)]
    queries = [(q, list({*r.choices(words, k=r.choice((1, 2, 8)))})) for q in range(40)] + [(40, ["none"]), (41, ["w0", "none"])]
    hybrid.write(hybrid.postings(spark.createDataFrame(docs, "id bigint, text string")), str(tmp_path / "p"))
    rows = spark.read.schema("term string, id bigint, r double, band int").parquet(str(tmp_path / "p"))
    asked, n = spark.createDataFrame([(q, w) for q, ws in queries for w in ws], "query_id bigint, term string"), spark.createDataFrame([(len(docs),)], "n_docs bigint")
    got = collections.defaultdict(list)
    for x in hybrid.lexical(rows, hybrid.maxima(rows), asked, n, k).collect():
        got[x.query_id].append((x.rank, -x.score, x.id))
    want = plain(docs, queries, k)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    read = hybrid.wanted(asked, hybrid.maxima(rows), n, k).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("needed"), F.col("n"))).alias("read")).first()
    assert read.read <= read["all"] and (k > 1 or read.read < read["all"])


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "query_id bigint, id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, id bigint, rank int")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in hybrid.fused(a, b, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 11, 10**12 // 62 + 10**12 // 61), (1, 2, 10, 10**12 // 61), (2, 1, 5, 10**12 // 61)]


def test_dense_queries_are_a_bounded_set(spark, monkeypatch):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id bigint, dense array<float>")
    q = p.select(F.col("id").alias("query_id"), F.col("dense").alias("vector")).where("id = 1")
    assert [(r.id, r.score) for r in hybrid.dense(p, q, 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    monkeypatch.setattr(hybrid, "MOST_QUERIES", 0)
    with pytest.raises(ValueError):
        hybrid.dense(p, q, 5)


def test_containers_are_the_widest_that_fit(spark):
    deep = [f"s{i}" for i in range(8)]
    rows = [(1, 0, ["A"], "a" * 60), (1, 1, ["A", "B"], "b" * 30), (1, 2, ["A", "B", "C"], "c" * 20), (1, 3, ["A", "D"], "d" * 200), (1, 4, [], "e"), (2, 0, ["S"], "f" * 10), (3, 0, deep, "g" * 40), (3, 1, deep[:3], "h" * 40)]
    c = spark.createDataFrame(rows, "document_id bigint, chunk_no int, section_path array<string>, content_text string")
    tree = containers.sections(c, 100)
    got = {(r.document_id, ">".join(r.section_path)): (r.parent_path and ">".join(r.parent_path), r.level, r.n_chunks, r.n_chars, r.fits) for r in tree.collect()}
    assert got[1, "A"] == (None, 1, 4, 310, False) and got[1, "A>B"] == ("A", 2, 2, 50, True) and got[2, "S"] == (None, 1, 1, 10, True) and got[3, ">".join(deep)][1:4] == (8, 1, 40) and len(got) == 13
    home = {(r.document_id, r.chunk_no): r.container_path and ">".join(r.container_path) for r in containers.assigned(c, tree).collect()}
    assert home == {(1, 0): None, (1, 1): "A>B", (1, 2): "A>B", (1, 3): None, (1, 4): None, (2, 0): "S", (3, 0): "s0", (3, 1): "s0"}
    whole = {(r.document_id, r.section_path[-1]): (r.chunk_nos, r.content_text) for r in containers.containers(c, tree).collect()}
    assert whole[1, "B"] == ([1, 2], "b" * 30 + "\n" + "c" * 20) and whole[3, "s0"][0] == [0, 1] and len(whole) == 3


ELEMENT = "document_id bigint, element_id bigint, page_number bigint, element_type string, text string, section_path array<string>, components array<string>, connections array<string>, description string, kg_stamp string"


def test_only_stale_elements_are_read_again(spark):
    before, after = kg.Words({"pump": "Component", "fan": "Component", "old": "Component"}), kg.Words({"pump": "Component", "fan": "Sensor", "valve": "Component"})
    assert kg.Words({"fan": "Component", "pump": "Component", "old": "Component"}).stamp == before.stamp and after.changed(before) == ["fan", "old", "valve"]
    texts = ["The pump", "a Fan here", "a valve", None, "fantastic", "TH3 and the old one", "nothing"]
    rows = [(1, i, 1, "paragraph", t, [], None, None, "valve seen" if i == 6 else None, before.stamp) for i, t in enumerate(texts)]
    rows += [(1, 20, 1, "paragraph", "pump", [], None, None, None, None), (1, 21, 1, "paragraph", "pump", [], None, None, None, "unknown")]
    e = spark.createDataFrame(rows, ELEMENT)
    stored = kg.extract(e, before)
    out = kg.reextract(stored, after, [before])
    assert {r.element_id for r in out.where("extracted").collect()} == {1, 2, 5, 6, 20, 21}
    pick = lambda df: {r.element_id: sorted((x.name, x.entity_type) for x in r.entities) for r in df.collect()}
    assert pick(out) == pick(kg.extract(e, after)) and {r.kg_stamp for r in out.collect()} == {after.stamp}
    again = kg.reextract(out.drop("extracted"), after, [before])
    assert again.where("extracted").count() == 0 and pick(again) == pick(out)
