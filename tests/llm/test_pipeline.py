import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import queries
from tests.llm import test_line_dedup, test_mixing, test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and what it gives."""
    from tessera.llm.common import materialize, read

    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), "test")
        out.append((docs, after))
        docs = after
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_classifier_rejects_what_the_query_rejects(spark, steps):
    good = {r.doc_id for r in queries.op10_quality_classifier(spark, SF).collect() if r.predicted}
    before, after = steps[0]
    assert {r.doc_id for r in after.collect()} == good and 0 < len(good) < before.count()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lines(steps):
    before, after = steps[1]
    want = test_line_dedup.brute([r[:2] for r in rows(before)])
    got = sorted(((False, r[0]), hashlib.sha256(r[1].encode()).hexdigest()) for r in rows(after))
    assert got == sorted((i, h) for i, _, _, h in want)


def test_near_duplicates(steps):
    before, after = steps[2]
    heads = {i[1] for i, _, c in test_ngram_join.brute([r[:2] for r in rows(before)]) if i[1] == c}
    assert {r[0] for r in rows(after)} == heads


def test_mix(steps):
    before, after = steps[3]
    want = {i: taken // size if size else 0 for _, i, size, _, _, taken in test_mixing.brute(rows(before))}
    assert Counter(r[0] for r in rows(after)) == Counter({i: n for i, n in want.items() if n})


def test_tokens(steps):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(queries.tokenizer_file().decode())
    before, after = steps[4]
    want = Counter()
    for r in rows(before):
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0], tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in after.collect()) == want


def test_run(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, rows(out))) == sorted(map(str, rows(steps[-1][1])))


def test_no_rows(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_a_stage_begins_with_a_full_collection(spark, none):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Scavenge" not in b.getName() and b.getName() != "Copy")
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        docs = stage(spark, docs, SF)
        assert full() > before, name
