import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with near and exact copies, shared lines, nulls, empty and long texts, repeated ids and rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(words(rng, rng.randint(3, 25)) + "." for _ in range(rng.randint(1, 5)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    base = rows[3][1]
    for i in range(n, n + 8):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(n + 8 + k, base, "en", "b") for k in range(3)]  # exact copies
    shared = "This Very Line is in MANY documents"
    rows += [(n + 11 + k, f"{words(rng, 6)}\n  {shared.upper() if k % 2 else shared}\t\n{words(rng, 5)}\n{shared}", "de", "c") for k in range(5)]
    rows += [(n + 16, None, None, None), (n + 17, "", "en", "a"), (n + 18, " \n\t ", "en", "a"), (n + 19, words(rng, 30_000), "en", "a"), (None, base, "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3]), (6, "another text of document six that nobody else has", "en", "b")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(("score", "size", "doc", "row", "key", "line", "pos", "h", "words", "root", "target", "_text", "plan_source", "n_tokens", "hashes", "copies", "_whole", "_words", "_b_id", "_lines", "_mix_whole", "_mix_n", "_quality_score", "_kept_id", "_n", "_t", "_tn", "_TWords"))])
