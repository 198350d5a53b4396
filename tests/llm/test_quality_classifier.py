import random

import numpy as np
import pytest

from tessera.llm import quality_classifier as qc


def some(seed, n=400):
    """Clean texts, and shouting, stammering, symbol-ridden ones; some labels are wrong."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["ka", "to", "li", "mer", "ste"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))]
        bad = rng.random() < 0.25
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x for x in w for _ in range(6)] if kind == 1 else [x + rng.choice(["$$$", "###", "&&&"]) for x in w]
        rows.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, int(not bad) if rng.random() < 0.97 else int(bad), 0))
    return rows, labels, {i: not any(c in t for c in "!$#&") and not any(a == b == c for a, b, c in zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in rows}


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels, true = some(1)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), true


def test_held_out_accuracy(tables):
    docs, labels, true = tables
    out = [r for r in qc.classify(docs, labels).collect() if r.held_out]
    assert len(out) > 40 and sum(bool(r.predicted) == true[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_real_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = qc.classify(docs, labels).filter("held_out").join(labels, "doc_id")
    assert out.filter("predicted = quality").count() / out.count() > 0.95


def test_held_out_labels_do_not_matter(tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(r[:] for r in qc.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_descent_finds_the_best_margin():
    """On a problem that can be parted the dual solution meets the conditions of the optimum."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(40)]
    scale = rng.normal(size=30)
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    cost = np.full(40, 0.7)
    w, b = qc.descend(rows, scale, y, cost, epochs=3000)
    x = np.zeros((40, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 30] = 1
    v = np.append(w, b)
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = objective(v)
    assert all(objective(v + rng.normal(size=31) * s) >= best - 1e-3 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_indicators():
    f = qc.Features()
    assert len(f("")) == 0 and len(f("a b c")) == len(np.unique(f("a b c")))
    assert np.array_equal(f("ein Text"), f("ein Text")) and len(f("x" * 200_000)) < 20
    stammer, plain = set(f("go go go go go").tolist()), set(f("go to no so lo").tolist())
    assert len([k for k in stammer - plain if k >= qc.WORD_SPACE + qc.CLASS_SPACE]) >= 4


def test_odd_rows(spark, none, clashing, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1), (7, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for table in (labels, empty):
        out = qc.classify(clashing, table)
        assert out.count() == docs.count() and out.filter("score is null or predicted is null or score < 0 or score > 1").count() == 0
        assert qc.classify(none, table).count() == 0
    assert {round(r.score, 6) for r in qc.classify(docs, empty).collect()} == {0.5}


def test_good_documents_keep_their_columns(tables):
    docs, labels, true = tables
    out = qc.good_documents(docs, labels)
    assert out.columns == docs.columns
    wanted = {r.doc_id for r in qc.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == wanted


def plain_indicators(text):
    """The indicators of a text, one by one."""
    import zlib

    mask, times = (1 << 32) - 1, 2654435761
    found, raw = set(), text.encode()
    tokens = raw.lower().split()
    if tokens:
        h = [zlib.crc32(t) for t in tokens]
        found |= {(x * times & mask) >> 15 for x in h} | {(((a * 31 + b) & mask) * times & mask) >> 15 for a, b in zip(h, h[1:])}
        runs, most, same = 0, 0, 0
        for a, b in zip(tokens, tokens[1:]):
            runs = runs + 1 if a == b else 0
            most, same = max(most, runs), same + (a == b)
        at = qc.WORD_SPACE + qc.CLASS_SPACE
        found |= {at + k for k in range(min(most, qc.RUN) + 1)}
        found |= {at + qc.RUN + 1 + k for k, x in enumerate(qc.SHARES) if same / len(tokens) >= x}
    kinds = []
    for b in raw:
        k = "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else " " if 9 <= b <= 13 else chr(b)
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    for i in range(len(kinds)):
        h = 0
        for n, k in enumerate(kinds[i : i + qc.CLASS_N], 1):
            h = ord(k) if n == 1 else (h * 257 + ord(k)) & mask
            found.add(qc.WORD_SPACE + ((((h + n) & mask) * times & mask) >> 18))
    return sorted(found)


TEXTS = ["", " ", "One", "a a a a b", "Word, word! 12 34\t\n$$ é", "x " * 50, "ÄÖ 9" * 30, "the cat The CAT the cat"]


def test_indicators_by_brute_force():
    features = qc.Features()
    for t in TEXTS + [r[1] for r in some(5, 40)[0]]:
        assert sorted(features(t).tolist()) == plain_indicators(t)


def test_score_by_brute_force(tables, spark):
    """Every score recomputed text by text from the ratios, weights and the curve."""
    docs, labels, _ = tables
    docs = docs.unionAll(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string"))
    scale, m = qc.fit(docs, labels)
    for r in qc.score(docs, (scale, m), ("doc_id", "text")).collect():
        at = plain_indicators(r.text or "")
        n = sum(float(scale[i]) ** 2 for i in at) ** 0.5
        margin = (sum(float(m.weights[i]) for i in at) / n if n else 0.0) + m.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-(m.slope * margin + m.shift))), abs=1e-5)


def test_ratios_and_the_dual_optimum():
    """Ratios counted one by one; at the optimum no coordinate of the dual wants to move."""
    rows_, labels, _ = some(3, 120)
    good = {i: q for i, q, _ in labels}
    some_rows = [(np.array(plain_indicators(t), np.int32), 1.0 if good[i] else -1.0) for i, t in rows_ if i in good]
    rows, y = [r for r, _ in some_rows], np.array([k for _, k in some_rows])
    scale = qc._ratios(rows, y)
    n_good, n_bad = (y > 0).sum() + 2, (y < 0).sum() + 2
    for f in sorted({int(i) for r in rows for i in r})[::97]:
        a, b = (1 + sum(f in r for r, k in zip(rows, y) if (k > 0) == side) for side in (True, False))
        assert scale[f] == pytest.approx(np.log(a / n_good) - np.log(b / n_bad))
    cost = np.full(len(y), 0.7)
    w, bias = qc.descend(rows, scale, y, cost, epochs=400)
    x = [scale[r] / (np.sqrt((scale[r] ** 2).sum()) or 1) for r in rows]
    primal = 0.5 * (w @ w + bias**2) + sum(c * max(0.0, 1 - k * (w[r] @ v + bias)) for r, v, k, c in zip(rows, x, y, cost))
    for step in (1e-2, -1e-2):  # the objective is convex: shifting the weights or the bias makes it worse
        for at, off in ((0.0, step), (step, 0.0)):
            u, b = w * (1 + at), bias + off
            assert 0.5 * (u @ u + b**2) + sum(c * max(0.0, 1 - k * (u[r] @ v + b)) for r, v, k, c in zip(rows, x, y, cost)) >= primal - 1e-3
