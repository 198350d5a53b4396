import random

import numpy as np
import pytest

from tessera.llm import language_id


def some(seed, n=300):
    rng = random.Random(seed)
    parts = {"aa": ["ba", "ko", "ti", "lu"], "bb": ["stra", "ung", "chen", "ver"], "cc": ["éa", "oux", "ié", "ç"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = some(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    true = {r[0]: r[2] for r in rows}
    out = [r for r in language_id.identify(df).collect() if r.held_out]
    assert len(out) > 50 and sum(r.lang_pred == true[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(df).filter("held_out").join(df.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang_pred = lang").count() / out.count() > 0.97


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    c = language_id.codewords(n)
    assert set(np.unique(c)) == {-1.0, 1.0}
    apart = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * 99
    assert apart.min() >= {2: 1, 3: 2, 4: 4, 7: 32}.get(n, c.shape[1] // 5)


def test_a_wrong_bit_is_corrected():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]))
    for k in range(4):
        for flip in range(code.shape[1]):
            margin = 3 * code[k]
            margin[flip] *= -1
            best, score = language_id.decode(model, margin[None, :].astype(np.float32))
            assert best[0] == k and score[0] > 0.5


def test_odd_rows(spark, docs):
    rows = [*some(2, 60), (1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "aa"), (1003, "ba ko " * 50_000, None), (None, "stra ung verchen", None), (1, "ba", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {}
    for r in language_id.identify(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [(out[k][0].lang_pred, out[k][0].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[1003][0].lang_pred == "aa" and out[None][0].lang_pred == "bb" and len(out[1]) == 2
    assert language_id.identify(docs).count() == docs.count()


def test_nothing_or_one_language_to_learn(spark, none, clashing):
    assert language_id.identify(none).count() == 0
    df = spark.createDataFrame([(k, "ba ko", None) for k in range(5)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(df).collect()} == {("und", 0.0)}
    df = spark.createDataFrame([(k, "ba ko", "aa") for k in range(12)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(df).collect()} == {("aa", 1.0)}
    assert language_id.identify(clashing).count() == clashing.count()


def test_every_labelled_language_is_learned(spark):
    """Among many rows of one language and many texts without letters."""
    rows = [(k, "ba ko ti", "aa") for k in range(900)] + [(1000 + k, "12 34", "bb") for k in range(900)]
    rows += [(2000 + k, "stra ung chen", "bb") for k in range(4)] + [(3000 + k, "oux", "cc") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language_id.fit(df, 12).languages == ["aa", "bb", "cc"]
    assert {r.lang_pred for r in language_id.predict(df.filter("doc_id >= 2000"), language_id.fit(df, 12)).collect()} == {"bb", "cc"}
    known = df.filter(~language_id.held_out(df.doc_id))
    found = {}
    for r in language_id.pick(known, 12).collect():
        found.setdefault(r.p_lang, set()).add(r.p_doc_id)
    order = known.filter("lang = 'aa'").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()
    assert sum(map(len, found.values())) == 12 and found["aa"] == {r.doc_id for r in order[: len(found["aa"])]}


def test_shares():
    assert language_id.shares({"a": 1000, "b": 2, "c": 50}, 100) == {"a": 49, "b": 2, "c": 49}
    assert language_id.shares({"a": 3, "b": 3, "c": 3}, 1) == {"a": 1, "b": 1, "c": 1} and language_id.shares({}, 5) == {}


def test_only_the_text_decides(spark):
    rows = some(3, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    a = language_id.predict(df, model).select("lang_pred", "score").collect()
    b = language_id.predict(spark.createDataFrame([(None, t) for _, t, _ in rows], "doc_id long, text string"), model).select("lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def plain_shares(text):
    """Square roots of the shares of hashed n-grams, counted one by one."""
    mask, times = (1 << 32) - 1, 2654435761
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.encode().lower() + b" "]
    raw = [b for k, b in enumerate(raw) if not k or b != 32 or raw[k - 1] != 32]
    counts = {}
    for i in range(len(raw)):
        h = 0
        for n, b in enumerate(raw[i : i + max(language_id.LENGTHS)], 1):
            h = b if n == 1 else (h * 263 + b) & mask
            at = (((h + n) & mask) * times & mask) >> 20
            counts[at] = counts.get(at, 0) + 1
    total = sum(counts.values())
    return {k: (n / total) ** 0.5 for k, n in counts.items()}


def test_predictions_by_brute_force(spark):
    """Bits, losses and shares recomputed text by text and bit by bit."""
    rows = some(4, 120) + [(1000, "", "aa"), (1001, None, "bb"), (1002, "12 3!", "cc"), (1003, "é", None), (1004, "Stra Ung BA", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, m).collect()}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == (language_id.UNKNOWN, 0.0)
            continue
        x, loss = plain_shares(text), []
        for word in m.code:
            bits = [sum(v * float(m.weights[k, b]) for k, v in x.items()) + float(m.bias[b]) for b in range(len(word))]
            loss.append(sum(np.log1p(np.exp(-bit * sign)) for bit, sign in zip(bits, word)))
        share = [np.exp(min(loss) - v) for v in loss]
        best = max(range(len(share)), key=share.__getitem__)
        assert got[i].lang_pred == m.languages[best] and got[i].score == pytest.approx(share[best] / sum(share), abs=1e-4)
