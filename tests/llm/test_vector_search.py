import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k=5):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, set()).add(tuple(math.floor(256 * float(np.float32(c))) for c in x))
    out = []
    for q in sorted(i for i in v if i % every == 0):
        best = {}
        for a in v[q]:
            for i in v:
                for b in v[i]:
                    if i != q and len(a) == len(b):
                        best[i] = max(best.get(i, -(10**18)), sum(x * y for x, y in zip(a, b)))
        top = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(top)]
    return out


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def search(spark, rows, every=5, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return vector_search.top_k(df, F.col("vec_id") % every == 0)


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors(spark, seed, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 7)
    monkeypatch.setattr(vector_search, "CANDIDATE_ROWS", 20)
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # ties
    assert got(search(spark, rows)) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (10, [3.0, 0.0, 1.0]), (7, []), (15, []), (8, [-1.0, -2.0]), (0, [1.0, 2.0]), (9, [0.001, -0.001])]
    assert got(search(spark, rows)) == brute(rows, 5)


def test_several_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [0.5, 1.0]), (2, [0.7, 0.7])]
    assert got(search(spark, rows)) == brute(rows, 5)


@pytest.mark.parametrize("rows_a_block", [4, 12, 4096])
def test_an_id_that_stands_often_takes_one_place(spark, monkeypatch, rows_a_block):
    """Repeated rows and several vectors of one id do not push the next neighbours out."""
    monkeypatch.setattr(vector_search, "CANDIDATE_ROWS", rows_a_block)
    rng = np.random.default_rng(7)
    rows = [(0, [1.0, 0.0, 0.0])] + [(7, [9.0, 0.0, 0.0])] * 8 + [(8, [8.0 + k / 8, 0.0, 0.0]) for k in range(7)]
    rows += [(10 * k + 1, rng.normal(size=3).tolist()) for k in range(40)]
    rng.shuffle(rows)
    rows = [(int(i), [float(y) for y in x]) for i, x in rows]
    assert len(brute(rows, 50)) == 5 and got(search(spark, rows, 50)) == brute(rows, 50)


def test_block_with_repeated_ids():
    rng = np.random.default_rng(8)
    ids, c, q = rng.integers(0, 30, 200), rng.integers(-50, 50, (200, 8)), rng.integers(-50, 50, (6, 8))
    ids[:60] = 3
    for scale in (1, 2**40):  # the second is beyond what floats hold
        found = vector_search.search_block(np.arange(6), q * scale, ids, c, 5)
        expect = []
        for i in range(6):
            best = {j: max(sum(int(x) * scale * int(y) for x, y in zip(q[i], c[r])) for r in np.flatnonzero(ids == j)) for j in set(ids.tolist()) - {i}}
            expect += [(i, j, s) for j, s in sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5]]
        assert found == expect


def test_no_rows_and_clashing_names(spark):
    assert search(spark, []).count() == 0
    assert search(spark, [(1, [1.0])]).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as dim", "3 as score", "4 as rank", "5 as ids")
    assert got(vector_search.top_k(df, F.col("vec_id") % 5 == 0)) == brute(rows, 5)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(30, 17)) * 40, rng.normal(size=(50, 17)) * 40
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    last = np.zeros_like(exact)
    for segments in (1, 4, 16):
        a, b = vector_search.statistics(q, segments), vector_search.statistics(c, segments)
        low = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (low <= exact + 1e-6).all()
        last = low
    assert last.mean() > 0.5 * exact.mean()


def test_bounds_leave_few_exact_scores():
    """Of random unit vectors the finest statistics leave well under a third of the pairs; a rotation helps where coordinates hang together, and loses nothing."""
    rng = np.random.default_rng(6)
    for mix in (np.eye(64), rng.normal(size=(64, 64)) * np.geomspace(1, 0.05, 64)):
        x = rng.normal(size=(3000, 64)) @ mix
        x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
        ids, q = np.arange(3000), x[::60]
        scores = (q @ x.T).astype(float)
        scores[np.arange(50), np.arange(0, 3000, 60)] = -np.inf
        floor = np.sort(scores, axis=1)[:, -5]
        left = vector_search.survivors(ids[::60], q, ids, x, 5, floor, vector_search.turn(x[:500]))
        assert left[scores >= floor[:, None]].all() and left.mean() < 0.3


def test_several_parts_and_rising_floors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(vector_search, "PART_ROWS", 64)
    monkeypatch.setattr(vector_search, "SAMPLE_ROWS", 20)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=12) * np.geomspace(1, 0.1, 12)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rng.normal(size=7).astype(np.float32).tolist()) for i in range(60)] + [(7, rows[8][1])] * 5
    assert got(search(spark, rows)) == brute(rows, 5)
