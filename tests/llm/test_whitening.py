"""Whitening against numpy on small tables with odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loomdoc.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int"


def vectors(n: int, dim: int, seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) @ r.normal(size=(dim, dim)) * 0.3 + r.normal(size=dim)
    return [(i, [float(c) for c in row], 1, 7) for i, row in enumerate(x.astype(np.float32))]


def by_brute_force(rows: list[tuple], k: int) -> dict:
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows], object)
    n, total = len(x), x.sum(0)
    scaled = n * x - total
    cov = (scaled.T @ scaled / n**3).astype(float)
    e, u = np.linalg.eigh(cov)
    return {"n": n, "deviation": (scaled**2).sum(1), "e": e[::-1][:k], "u": u[:, ::-1][:, :k], "trace": cov.trace(), "centred": (scaled / n).astype(float)}


def check(got: list, rows: list[tuple], k: int) -> None:
    want = by_brute_force(rows, k)
    assert len(got) == len(rows) * k
    white = np.full((len(rows), k), np.nan)
    place = {}
    for i, r in enumerate(rows):
        place.setdefault(r[0], []).append(i)
    for r in got:
        i = place[r.vec_id][0]
        white[i, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (want["n"], want["deviation"][i])
        assert r.explained == pytest.approx(want["e"][r.component - 1] / want["trace"], rel=1e-9) and r.identity_error < 1e-9
    expected = want["centred"] @ want["u"] / np.sqrt(want["e"])
    one = ~np.isnan(white[:, 0])
    sign = np.sign((white[one] * expected[one]).sum(0))
    assert np.allclose(white[one], expected[one] * sign, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("dim,k", [(5, 5), (40, 32), (70, 32)])
def test_whitening(spark, monkeypatch, dim, k):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rows = vectors(400, dim, dim)
    odd = [(900, None, 1, 1), (901, [], 1, 1), (902, [1.0] * (dim - 1) + [None], 1, 1), (903, [float("nan")] * dim, 1, 1), (904, [float("inf")] + [0.0] * (dim - 1), 1, 1), (905, [1.0] * (dim + 1), 1, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), rows, k)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(60, 4, 3)
    rows = rows + rows[:7] + [(None, rows[3][1], 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 4).collect()
    check(got, rows, 4)
    assert sum(r.vec_id is None for r in got) == 4


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**31 + 4096 * i), float((i * 7919) % 13) * 2**28], 1, 1) for i in range(40)]
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 2)
    want = by_brute_force(rows, 2)
    got = df.collect()
    assert {r.deviation for r in got} == {None if d >= 1 << 63 else d for d in want["deviation"]}
    w = whitening.fit(whitening.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"), 2)
    assert np.allclose(w.values, want["e"], rtol=1e-12)


def test_what_has_no_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1)], SCHEMA)).count() == 0
    for rows in ([(1, [1.0, 2.0, 3.0], 1, 1)], [(i, [1.0, 2.0, 3.0], 1, 1) for i in range(9)]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == 3 * len(rows) and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    flat = [(r[0], [*r[1], r[1][0]], 1, 1) for r in vectors(50, 2, 1)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got if r.whitened is None} == {3} and max(r.identity_error for r in got) < 1e-9
