import random
from collections import Counter

from tessera.llm import quality_rules


def brute(text, window=5):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    grams = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for k, g in enumerate(grams) if g in twice for j in range(k, k + window)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def table(rows):
    return sorted((r[0] is None, r[0] or 0, *brute(r[1])) for r in rows)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect())


def test_documents(docs, rows):
    out = quality_rules.apply_rules(docs)
    assert got(out) == table(rows)
    for r in out.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.outlier == "")


def test_measures(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a a a", "a b c d", "x|y <z> # $%&*", "l\n l\nl\n\n\nl", "é ü\x0bÜ\x1f z", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert got(quality_rules.measures(df)) == table(rows)


def test_fences_adapt(spark):
    """What is usual in one language and source is odd in another."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(600):
        n = (4, 12)[k % 2]
        rows.append((k, " ".join(word(rng.randint(n - 1, n + 1)) for _ in range(40)), "en", ("short", "long")[k % 2]))
    rows += [(1000, " ".join(word(12) for _ in range(40)), "en", "short"), (1001, " ".join(word(12) for _ in range(40)), "en", "long"), (1002, " ".join(f"{word(4)}$$$" for _ in range(40)), "en", "short"), (1003, " ".join(word(4) for _ in range(40)), "en", None)]
    out = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[1000].kept and out[1001].kept and not out[1002].kept and "symbols_per_word" in out[1002].outlier and out[1003].kept
    assert all(out[k].kept for k in range(600))


def test_no_python_in_the_plan(docs):
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().toString() + quality_rules.measures(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows_and_clashing_names(none, clashing, rows):
    assert quality_rules.apply_rules(none).count() == 0
    assert got(quality_rules.apply_rules(clashing)) == table(rows)
