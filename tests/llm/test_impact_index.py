"""The bit-sliced impact index against plain scoring, its arithmetic against whole numbers."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from loomdoc.llm import impact_index

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, rank int, term string"


def terms(text: str | None) -> list[str]:
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(("Alpha", "beta", "gamma,", "DELTA-4", "été", "ÉTÉ", "x_y", "日本語", "zeta's", *map(str, range(60)))) for _ in range(n))


def documents() -> list[tuple]:
    r = random.Random(5)
    rows = [(i, prose(r, r.choice((1, 5, 30, 200)))) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # ties over the edge of k
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, "beta"), (400, None), (401, ""), (402, " .,;\n"), (403, prose(r, 30_000)), (404, "q" * 5000)]
    return rows


def items() -> list[tuple]:
    return [(1, "alpha BETA beta"), (2, documents()[3][1]), (2, "gamma 7"), (3, None), (4, "nothing-like-it"), (5, "été 日本語 x 59"), (None, "delta 4"), (6, "...")]


def by_brute_force(rows: list[tuple], queries: list[tuple], k: int) -> collections.Counter:
    bags = [(i, collections.Counter(terms(t))) for i, t in rows]
    bags = [(i, b, b.total()) for i, b in bags if b]
    many, total = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = collections.Counter()
    for item, text in queries:
        scored = []
        for i, b, n in bags:
            m = 50 + (50 * n * many) // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("block,size,batch", [(16_384, 24 << 20, 100_000), (16, 24 << 20, 3), (16_384, 2000, 100_000)])
def test_search(spark, monkeypatch, block, size, batch):
    for name, value in (("BLOCK", block), ("BLOCK_BYTES", size), ("TERMS", batch)):
        monkeypatch.setattr(impact_index, name, value)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in documents()], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items()], "item_id bigint, text string, doc_id int")
    got = collections.Counter(tuple(r) for r in impact_index.search(docs, asked).select("item_id", "rank", "doc_id", "score").collect())
    assert got == by_brute_force(documents(), items(), 50)


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1, "x")], DOCS)
    asked = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert impact_index.search(none, asked).count() == 0
    assert impact_index.search(spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x")], DOCS), asked).count() == 0
    assert impact_index.search(some, asked.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in impact_index.search(some, asked).collect()] == [(1, 1, 1)]


def sliced(numbers: list[int]) -> list[int]:
    return [sum((n >> b & 1) << i for i, n in enumerate(numbers)) for b in range(max(numbers).bit_length())]


def test_arithmetic_on_slices():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice((0, r.randrange(1 << 20), 7)) for _ in range(40)] for _ in range(2))
        w = r.randrange(1 << 14)
        for made, want in ((impact_index.add(sliced(a), sliced(b)), [x + y for x, y in zip(a, b, strict=True)]), (impact_index.times(sliced(a), w), [x * w for x in a])):
            assert [sum((s >> i & 1) << j for j, s in enumerate(made)) for i in range(40)] == want
        k = r.randrange(1, 45)
        assert sorted(impact_index.top(sliced(a), k)) == sorted(sorted(((i, n) for i, n in enumerate(a) if n), key=lambda x: (-x[1], x[0]))[:k])


def test_statistics(spark):
    rows = [*documents(), (1, "ab"), (2, "cd"), (3, "é"), (4, " x"), (5, "y ")]
    bags = [len(terms(t)) for _, t in rows]
    assert impact_index.statistics(spark.createDataFrame([(t,) for _, t in rows], "text string").coalesce(1)) == (sum(n > 0 for n in bags), sum(bags))


def test_all_terms_are_indexed(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in documents()], DOCS).repartition(2)
    index = impact_index.build(docs, impact_index.statistics(docs))
    df = collections.Counter(t for _, x in documents() for t in set(terms(x)))
    got = collections.Counter()
    for r in index.where("term is not null").collect():
        got[r.term] += r.df
        assert len(r.places) == 2 * r.df and len(r.slices) == impact_index.BITS * -(-r.df // 8)
    assert got == df
