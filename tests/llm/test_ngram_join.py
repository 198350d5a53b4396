import random

import pytest

from tessera.llm import ngram_join


def lower(text):
    return (text or "").encode().lower().decode()


def sets(text, n=5):
    w = lower(text).encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def brute(rows):
    """Sizes and components by comparing all documents."""
    of = {}
    for i, t in rows:
        if i is not None:
            of.setdefault(i, []).append(sets(t))
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(of)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in of[a] for y in of[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i is None, i or 0), len(sets(t)), -1 if i is None else find(i)) for i, t in rows)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def near(seed, n=40, groups=4, most=14):
    """Groups of near copies with few and many changes, so that some link only over others and some not at all."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.randint(20, 90))]
        for _ in range(n // groups):
            w = list(base)
            for _ in range(rng.randint(0, most) * len(w) // 100):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(10**6)}"] * rng.randint(0, 2)
            rows.append((k, " ".join(w)))
            k += 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(k + j, f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randint(2, 60)))}") for j in range(12)]
    rng.shuffle(rows)
    return rows


def test_documents(docs, rows):
    assert got(ngram_join.near_duplicates(docs)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed):
    rows = near(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_join.near_duplicates(df)) == brute(rows)


def test_hubs_lose_no_link(spark, monkeypatch):
    """A large group goes through rounds of hubs before members of different components are compared."""
    rows = near(11, n=90, groups=1, most=18)
    turns = []
    real = ngram_join._open_lists
    monkeypatch.setattr(ngram_join, "_open_lists", lambda lists, roots, turn: turns.append(turn) or real(lists, roots, turn))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_join.near_duplicates(df)) == brute(rows)
    assert len(turns) > 1


def test_chunks_and_fragments_answer_alike(spark, monkeypatch):
    rows = near(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 3)
    assert got(ngram_join.near_duplicates(df)) == brute(rows)


def test_the_same_rows_twice(spark):
    rows = near(6, n=16)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(ngram_join.near_duplicates(df.unionAll(df))) == brute(rows + rows)


def test_contract(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for p in links for x in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    df = ngram_join.contract(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in df.collect()} == {x: find(x) for x in nodes}
    assert ngram_join.contract(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, rows):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    heads = {i[1] for i, _, c in brute([r[:2] for r in rows]) if not i[0] and i[1] == c}
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(heads) and ids.count(None) == 1


def test_one_of_repeated_rows_by_a_fixed_order(spark):
    rows = [(1, "b one text of its own", "x"), (1, "a quite another text here", "z"), (1, "a quite another text here", "y"), (1, None, "w"), (2, "c some third text stands alone", "v")]
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(some, "doc_id long, text string, source string").coalesce(1)
        assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == [(1, "a quite another text here", "y"), (2, "c some third text stands alone", "v")]


def test_no_rows_and_clashing_names(none, clashing, rows):
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    assert got(ngram_join.near_duplicates(clashing)) == brute([r[:2] for r in rows])
    assert ngram_join.one_of_each(clashing).columns == clashing.columns


def test_few_words(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a b c"), (4, ""), (5, None), (6, "a b c d e"), (7, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.near_duplicates(df)) == brute(rows)




@pytest.mark.parametrize("seed", range(2))
def test_last_lists_in_blocks(spark, monkeypatch, seed):
    """However small the blocks of the last lists are, no link is lost."""
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 4)
    rows = near(20 + seed, n=80, groups=2, most=20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_join.near_duplicates(df)) == brute(rows)


def test_pairs_of_a_list_come_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 7)
    rng = random.Random(3)
    members = [(1, k, rng.choice([12, 13, 15, 16, 17, 20, 21, 25, 28, 33, 45])) for k in range(60)]
    now = spark.createDataFrame([(h, k, s, s, k, 60) for h, k, s in members], "h long, rep long, size long, rest long, root long, members long")
    pairs = [(r.a, r.b, r.size_a, r.size_b) for r in ngram_join._across(now, 75, 100).collect()]
    expected = {(a, b, s, t) for _, a, s in members for _, b, t in members if a < b and 100 * min(s, t) >= 75 * max(s, t) and 175 * min(s, t) >= 75 * (s + t)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_cuts_part_the_order(spark):
    """Fragments follow the global order and hold about alike."""
    rng = random.Random(4)
    grams = [(min(50, 2 + int(rng.expovariate(0.4))), rng.randrange(-(2**63), 2**63)) for _ in range(4000)]
    ordered = spark.createDataFrame([(k, sorted(grams[k : k + 100])) for k in range(0, 4000, 100)], "rep long, g array<struct<df:long,h:long>>")
    at, df = ngram_join.cuts(ordered), {h: df for df, h in grams}
    parts = [(r.rep, r.fragment, [(df[h], h) for h in r.part]) for r in ngram_join.segments_of(ordered, at).collect()]
    of = sorted((x, f) for _, f, part in parts for x in part)
    assert [x for x, _ in of] == sorted(grams) and [f for _, f in of] == sorted(f for _, f in of) and at == sorted(at)
    sizes = [sum(f == k for _, f in of) for k in range(ngram_join.FRAGMENTS)]
    assert min(sizes) > 300 and max(sizes) < 700


def test_a_shingle_of_many_unlike_sets_is_in_no_list(spark, monkeypatch):
    """Ten words that thousands of else unlike texts share cost no pairs."""
    seen = []
    real = ngram_join._open_lists
    monkeypatch.setattr(ngram_join, "_open_lists", lambda lists, roots, turn: seen.append(lists.count()) or real(lists, roots, turn))
    passage = " ".join(f"p{i}" for i in range(10))
    rows = [(k, f"{passage} {' '.join(f'q{k}x{i}' for i in range(30))}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == {(k, k) for k in range(3000)}
    assert sum(seen) == 0


def test_intermediate_tables_fork_no_jvm_for_side_files(spark, monkeypatch):
    """Tables on a local file system: no check sums or marks beside the files, and those of links come from Python tasks, without folders of attempts."""
    from pathlib import Path

    from tessera.llm import common

    df = spark.range(1000, numPartitions=4).selectExpr("id", "struct(id as x, -id as y) as s", "if(id % 3 = 0, null, id > 5) as b")
    want = sorted(map(tuple, df.collect()))
    for arrow in (False, True):
        start = common.written()
        assert sorted(map(tuple, common.materialize(df, "plain", arrow=arrow).collect())) == want
        none = common.materialize(df.filter("id < 0"), "none", 0, arrow)
        assert none.isEmpty() and none.dtypes == df.dtypes
        for path in common._written[start:]:
            assert all(x.is_file() and x.name.startswith("part-") and x.name.endswith(".parquet") for x in Path(path.removeprefix("file://")).iterdir())
        common.discard(spark, start)
    calls = []
    monkeypatch.setattr(common, "_write_local", lambda d, folder, real=common._write_local: calls.append(folder) or real(d, folder))
    assert ngram_join.near_duplicates(spark.createDataFrame(near(3), "doc_id long, text string")).count() == len(near(3))
    assert any("join-links" in c for c in calls) and any("cc-links" in c for c in calls)
