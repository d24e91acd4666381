"""Lexical search dealt out by document: the same results whatever a task holds at a time, and no scores shuffled by query and document."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import hybrid, vectors

from .test_search import plain


def found(spark, docs, queries, k, at):
    hybrid.write(hybrid.postings(spark.createDataFrame(docs, "id bigint, text string").repartition(3)), at)
    rows = spark.read.schema("term string, id bigint, r double, band int").parquet(at)
    asked, n = spark.createDataFrame([(q, w) for q, ws in queries for w in ws], "query_id bigint, term string"), spark.createDataFrame([(len(docs),)], "n_docs bigint")
    return hybrid.lexical(rows, hybrid.maxima(rows, asked), asked, n, k)


def data(seed: int):
    r = random.Random(seed)
    words = [f"w{min(int(r.expovariate(0.1)), 60)}" for _ in range(400)]
    docs = [(i, " ".join(r.choices(words, k=r.choice((3, 20, 120))))) for i in range(200)] + [(200, None), (201, "İK KKelvin"), (202, "w0 " * 50)]
    return docs, [(q, list({*r.choices(words, k=r.choice((1, 2, 8)))})) for q in range(40)] + [(40, ["none"])]


@pytest.mark.parametrize(("rows", "sums", "most"), [(7, 1, 10_000), (50, 200, 6), (200_000, 1 << 21, 10_000)])
def test_what_a_task_holds_changes_nothing(spark, tmp_path, monkeypatch, rows, sums, most):
    for name, value in (("ROWS", rows), ("SUMS", sums), ("DOCS", rows), ("MOST_QUERIES", most)):
        monkeypatch.setattr(hybrid, name, value)
    docs, queries = data(rows)
    got = collections.defaultdict(list)
    for x in found(spark, docs, queries, 5, str(tmp_path / "p")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.id))
    assert got == {q: v for q, v in plain(docs, queries, 5).items() if v}


def test_rows_of_one_id_and_length_are_one_document(spark):
    docs = [(1, "a b"), (1, "a c"), (1, "a b c"), (None, "a a"), (None, "a b"), (2, "")] + [(3, f"x y{i}") for i in range(30)]
    got = {(r.term, r.id, round(r.r, 9)) for r in hybrid.postings(spark.createDataFrame(docs, "id bigint, text string").repartition(4)).collect()}
    mean = sum(len((t or "").split()) for _, t in docs) / len(docs)
    tf = collections.Counter((i, len(t.split()), w) for i, t in docs for w in t.split())
    want = {(w, i, round(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean)), 9)) for (i, dl, w), n in tf.items()}
    assert got == want and len(got) == len(tf)


def test_scores_are_not_shuffled(spark, tmp_path):
    docs, queries = data(3)
    out = found(spark, docs, [(q, [f"w{i}" for i in range(30)]) for q in range(50)], 3, str(tmp_path / "p"))
    assert out.count() == 150
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id", plan) and "MapInArrow" in plan


def test_lengths_of_vectors_are_taken_once(spark):
    p = spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, None)], "id bigint, dense array<float>")
    q = p.select(F.col("id").alias("query_id"), F.col("dense").alias("vector")).where("id > 26")
    out = hybrid.dense(p, q, 4)
    a, b = p.alias("a"), q.alias("b")
    want = a.crossJoin(b).select("query_id", "id", F.round(vectors.cosine(F.col("dense"), F.col("vector")), 9).alias("score")).where("score is not null")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, hybrid.ranked(want, 4).select(*out.columns).collect()))
    assert re.search(r"length#\d+ \* q#\d+\.length", out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0])
