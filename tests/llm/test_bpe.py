import hashlib
import random

import pytest

from tessera.llm import bpe
from tessera.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def file():
    return tokenizer_file()


@pytest.fixture(scope="module")
def library(file):
    return tokenizers.Tokenizer.from_str(file.decode())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def replay(word, merges):
    """Merges applied in order of rank, the plain way."""
    rank = {m: k for k, m in enumerate(merges)}
    parts = list(word[:-1]) + [word[-1] + "</w>"]
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        best = min(found)[0]
        k = 0
        while k < len(parts) - 1:
            if rank.get((parts[k], parts[k + 1])) == best:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            k += 1


def test_automaton_is_the_merges_in_order():
    """Random merge lists over a small alphabet, also merges of a token with itself, against replaying the merges."""
    rng = random.Random(7)
    for _ in range(40):
        tokens = [*"abc", *(c + "</w>" for c in "abc")]
        merges = []
        for _ in range(14):
            a = rng.choice([t for t in tokens if not t.endswith("</w>")])
            b = rng.choice(tokens)
            if (a, b) not in merges and a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        auto = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges, "</w>")
        order = {i: t for t, i in auto.index.items()}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [order[t] for t in auto.encode(word)] == replay(word, merges), (word, merges)


def test_random_texts(file, library):
    rng = random.Random(3)
    t = bpe.Tokenizer(file)
    parts = ["aaaa", "the", "ing", "'ll", "'S", " ", "\n", "!?", "12", "é", "é", "Σ", "İ", "日本", "<|endoftext|>", "<|start", "\x1c", " ", "ß", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 5000, "the" * 3000, "", " "]
    assert t.encode_all(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x[0] for x in t.digests(texts)] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_cache_gives_the_same(file, rows):
    texts = [r[1] or "" for r in rows]
    assert list(bpe.Tokenizer(file, 50).digests(texts)) == list(bpe.Tokenizer(file).digests(texts))


def test_documents(docs, rows, file, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, file).collect())
    assert got == sorted((r[0] is None, r[0] or 0, *expected(library, r[1])) for r in rows)


def test_ids_round_trip(docs, file, library):
    for r in bpe.encode_documents(docs, file).limit(20).collect():
        assert len(r.token_ids) == r.n_tokens and hashlib.sha256(library.decode(r.token_ids, skip_special_tokens=False).encode()).hexdigest() == r.decoded_sha256


def test_no_rows_and_clashing_names(none, clashing, docs, file):
    assert bpe.encode_digests(none, file).count() == 0 and bpe.encode_documents(none, file).count() == 0
    assert bpe.encode_digests(clashing, file).count() == docs.count()


@pytest.mark.parametrize("context", ["a{}b", "{}1", "1{}!"])
def test_every_code_point(file, library, context):
    t = bpe.Tokenizer(file)
    every = [context.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(every[k : k + 2000]) for k in range(0, len(every), 2000)]
    assert t.encode_all(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tables_as_they_are_sent(file, library, spark, rows):
    t, texts = bpe.loaded(bpe.packed(spark, file)), [r[1] or "" for r in rows] + ["x" * 500, "日本語" * 300]
    assert t.encode_all(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
