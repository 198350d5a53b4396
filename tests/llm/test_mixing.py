import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def size(text):
    return len((text or "").encode().split())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Dealing out by weight again and again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = share * sum(sizes.values())
    full = set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def brute(rows):
    sizes, hashes = defaultdict(int), defaultdict(lambda: defaultdict(int))
    h = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    for r in rows:
        sizes[r[3]] += size(r[1])
        hashes[r[3]][h(r[0])] += size(r[1])
    t = brute_targets(sizes)
    cut, whole = {}, {}
    for s in sizes:
        whole[s] = int(t[s] // sizes[s]) if sizes[s] else 0
        left, cut[s] = t[s] - whole[s] * sizes[s], 0
        for x in sorted(hashes[s]):
            if left <= 0:
                break
            if hashes[s][x] <= left or 2 * left >= hashes[s][x]:
                cut[s] = x + 1
            left -= hashes[s][x]
    return sorted((r[0] is None, r[0] or 0, size(r[1]), sizes[r[3]], round(t[r[3]], 6), size(r[1]) * (whole[r[3]] + (h(r[0]) < cut[r[3]]))) for r in rows)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_documents(docs, rows):
    assert got(mixing.mix(docs)) == brute(rows)


def test_reruns_and_partitions_agree(docs):
    assert got(mixing.mix(docs)) == got(mixing.mix(docs.repartition(7)))


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 50_000]) for k in range(9)} | {None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(found[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_near_target(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{min(rng.randrange(8), 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= 20 and r.over <= 0


def test_mixed_documents(docs, rows):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    n = sum(taken[r[0], size(r[1])] for r in rows if size(r[1]))
    assert out.count() == n


def test_no_rows_and_clashing_names(none, clashing, rows):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert got(mixing.mix(clashing)) == brute(rows)
    assert mixing.mixed_documents(clashing).columns == clashing.columns
    assert mixing.mix(none.sparkSession.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).agg(F.sum("taken")).first()[0] == 0
