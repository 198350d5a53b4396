import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import class_lm


def tokens(text):
    return class_lm.tokens_of(text)


def brute(rows):
    """Counts and base scores the plain way."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    return sorted((r[0] is None, r[0] or 0, held(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), 4)) for r in rows)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in df.collect())


def test_counts_and_base(docs, rows):
    assert got(class_lm.score_documents(docs)) == brute(rows)


def test_rare_words_are_joined(docs, rows, monkeypatch):
    """With hardly any words in the tasks' table the scores are the same."""
    full = {(r.doc_id, r.n_tokens): r.score for r in class_lm.score_documents(docs).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 3)
    few = class_lm.score_documents(docs)
    assert got(few) == brute(rows)
    assert all(math.isfinite(r.score) for r in few.collect()) and len(full) > 50


def test_end_and_case():
    assert tokens(None) == tokens("") == tokens(" \n") == [class_lm.END]
    assert tokens("AbÉ\x0bc") == ["abÉ".encode(), b"c", class_lm.END]


def likelihood(n, of, classes):
    m = np.zeros((classes, classes))
    np.add.at(m, (of[:, None], of[None, :]), n)
    f = lambda a: (a[a > 0] * np.log(a[a > 0])).sum()
    return f(m) - f(m.sum(0)) - f(m.sum(1))


def test_exchange_raises_the_likelihood_and_stops_at_a_local_best():
    rng = np.random.default_rng(1)
    kind = np.array([0, 1, 2] * 7 + [3])
    n = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :] % 3, 30, 2))
    of = class_lm.exchange(n, 4, 50)
    best = likelihood(n, of, 4)
    assert best >= likelihood(n, kind, 4) - 1e-6
    for w in range(len(n) - 1):
        for k in range(3):
            other = of.copy()
            other[w] = k
            assert likelihood(n, other, 4) <= best + 1e-6


def learned(docs, sweeps=1):
    train = docs.filter(~class_lm.held_out(docs.doc_id)).select("text")
    return class_lm.cluster(train, sweeps)


def test_frequent_words(docs, rows, monkeypatch):
    """The words that are counted most, and of equals the first."""
    count = Counter(t for r in rows for t in tokens(r[1]) if t != class_lm.END)
    want = sorted(count, key=lambda w: (-count[w], w))
    assert class_lm.frequent_words(docs, 10) == want[:10] and class_lm.frequent_words(docs, 10**6) == want
    monkeypatch.setattr(class_lm, "MANY", 50)  # words met once in a task are left out
    assert class_lm.frequent_words(docs, 10) == want[:10]


def test_frequent_words_however_dealt(spark, monkeypatch):
    """Words that each task meets once count as often as they are there; many equally frequent words are no fewer types."""
    texts = [(f"often{k % 3} often{k % 3} " + " ".join(f"rare{k}x{i}" for i in range(40)) + " spread",) for k in range(40)]
    monkeypatch.setattr(class_lm, "MANY", 30)
    monkeypatch.setattr(class_lm, "HEAD", 50)
    for parts in (1, 8, 40):
        df = spark.createDataFrame(texts, "text string").repartition(parts)
        assert class_lm.frequent_words(df, 6) == [b"spread", b"often0", b"often1", b"often2", b"rare0x0", b"rare0x1"]
    equal = spark.createDataFrame([(" ".join(f"w{i:03}" for i in range(200)),)], "text string")
    assert class_lm.frequent_words(equal, 3) == [b"w000", b"w001", b"w002"]


def test_probabilities_sum_to_one(docs):
    """Words of a class and the endings of its unseen ones; classes after a class."""
    m = learned(docs)
    size = len(m.index)
    total = np.bincount(m.classes[:size], m.n + 0.1, class_lm.CLASSES) + 0.1 * np.bincount(m.classes[size:], minlength=class_lm.CLASSES)
    assert np.allclose(total, m.below())
    rng = np.random.default_rng(1)
    assert np.allclose((10 ** class_lm.transitions(rng.poisson(3, (40, 40)), rng.poisson(30, 40))).sum(1), 1)


def plain_classes(m):
    """Every training word's class and count."""
    out = {w: (int(m.classes[i]), int(m.n[i])) for w, i in m.index.items()}
    for r in m.table.collect():
        assert out.setdefault(bytes(r[0]), (r[2], r[1])) == (r[2], r[1])
    return out


@pytest.mark.parametrize("head", [400_000, 30, 3])
@pytest.mark.parametrize("types", [1023, 5])
def test_score_by_brute_force(docs, rows, monkeypatch, head, types):
    """Transitions and scores recomputed token by token, however many words are looked up."""
    monkeypatch.setattr(class_lm, "HEAD", head)
    for name, value in (("WORD_TYPES", types), ("TYPES", types + class_lm.ENDING_TYPES + 1), ("END_TYPE", types + class_lm.ENDING_TYPES)):
        monkeypatch.setattr(class_lm, name, value)
    monkeypatch.setattr(class_lm, "BLOCK", 500)
    monkeypatch.setattr(class_lm, "FEW", 90)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    some = [r for r in rows if len(r[1] or "") < 20_000]
    few = docs.filter("text is null or length(text) < 20000")
    m = learned(few)
    known, size, c = plain_classes(m), len(m.index), class_lm.CLASSES
    count = Counter(t for r in some if not held(r[0]) for t in tokens(r[1]))
    assert {w: n for w, (_, n) in known.items()} == count
    of = lambda t: known[t][0] if t in known else int(m.classes[size + class_lm.ending_type(t) - types])
    between, class_n, units = np.zeros((c, c)), np.zeros(c), np.bincount(m.classes[size:], minlength=c).astype(float)
    for w, (k, n) in known.items():
        class_n[k] += n
        units[k] += 1
    for r in some:
        if not held(r[0]):
            k = [c - 1, *map(of, tokens(r[1]))]
            for x, y in zip(k, k[1:]):
                between[x, y] += 1
    share = (class_n + 1) / (class_n.sum() + c)
    expected = []
    for r in some:
        t, total, before = tokens(r[1]), 0.0, c - 1
        for w in t:
            k = of(w)
            total += math.log10((between[before, k] + 20 * share[k]) / (between[before].sum() + 20)) + math.log10((count[w] + 0.1) / (class_n[k] + 0.1 * units[k]))
            before = k
        expected.append((r[0] is None, r[0] or 0, len(t), round(total, 4)))
    found = class_lm.score(few.select("doc_id", "text"), m).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 4)) for r in found) == sorted(expected)


def test_words_go_where_their_bigrams_are_likeliest(docs, rows, monkeypatch):
    """Contexts counted token by token; the move by trying every class."""
    monkeypatch.setattr(class_lm, "WORD_TYPES", 5)
    monkeypatch.setattr(class_lm, "BLOCK", 300)
    c, end = class_lm.CLASSES, class_lm.END
    rng = np.random.default_rng(2)
    index = {b"w1": 0, b"w2": 1, end: 2}
    start = class_lm.Start(index, np.concatenate([[3, 4, c - 1], rng.integers(0, c - 1, class_lm.ENDING_TYPES)]), rng.poisson(20, (c, c)).astype(float))
    of = lambda t: int(start.classes[index[t]]) if t in index else int(start.classes[3 + class_lm.ending_type(t) - 5])
    sums = {}
    for r in rows:
        t = tokens(r[1])
        for i, w in enumerate(t):
            if w not in (b"w1", b"w2", end):
                x = sums.setdefault(w, np.zeros(2 * c))
                x[of(t[i - 1]) if i else c - 1] += 1
                x[c + of(t[i + 1])] += 1
    m = start.bigrams + 0.5
    expected = {}
    for w, x in sums.items():
        gain = [sum(x[d] * math.log(m[d, k] / m[:, k].sum()) + x[c + d] * math.log(m[k, d] / m[k].sum()) for d in range(c)) for k in range(c - 1)]
        expected[w] = (x[:c].sum(), max(gain))
        sums[w] = gain
    # the types here are the first two places
    got = class_lm.move_words(class_lm.count_contexts(docs, start, 2), start.bigrams).collect()
    assert len(got) == len(expected)
    for r in got:
        n, best = expected[bytes(r[0])]
        assert r[1] == n and sums[bytes(r[0])][r[2]] == pytest.approx(best)


def test_better_than_base(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = class_lm.score_documents(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_no_rows_and_clashing_names(none, clashing, rows, spark):
    assert class_lm.score_documents(none).count() == 0
    assert got(class_lm.score_documents(clashing)) == brute(rows)
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    held = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    r = class_lm.score_documents(held).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == pytest.approx(3 * math.log10(1.0))
