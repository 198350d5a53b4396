import hashlib
from collections import defaultdict

import pytest

from tessera.llm import line_dedup

SPACES = " \t\n\x0b\f\r"


def key(line):
    return line.strip(SPACES).encode().lower().decode()


def brute(rows):
    """The smallest document of each key, nulls last; lines of other documents go."""
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := key(x)) >= 10:
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((order(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def test_documents(docs, rows):
    assert got(line_dedup.dedup_lines(docs)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("slices", [(1,), (4, 1), (64, 4, 1)])
def test_slices_agree(docs, rows, slices):
    assert got(line_dedup.dedup_lines(docs, slices=slices)) == brute([r[:2] for r in rows])
    with pytest.raises(ValueError):
        line_dedup.drop_bitmaps(docs, slices=(4,))


def test_many_lines(spark):
    """Bitmaps of several words, with gaps between."""
    rows = [(1, "\n".join(f"a line with number {k}" for k in range(0, 700, 3))), (2, "\n".join(f"a line with number {k}" for k in range(700))), (3, "x\n" * 500 + "A LINE with number 3\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.dedup_lines(df)) == brute(rows)


def test_keys(spark):
    rows = [(2, "\x1f line of text É\x0b"), (1, "\x1f line of text é"), (4, "  ELEVEN CHARs"), (3, "eleven chars \t"), (5, "short"), (6, "short"), (7, "zehn zeich"), (8, "zehn zeich"), (9, "neun zeic"), (10, "neun zeic")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.dedup_lines(df)) == brute(rows)


def test_cleaned_documents(docs, rows):
    out = line_dedup.cleaned_documents(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert kept == sorted((*i, h) for i, _, _, h in brute([r[:2] for r in rows]))
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or len(r.text) == r.n_chars) for r in out.collect())


def test_no_python_in_the_plan(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_rows_and_clashing_names(none, clashing, rows):
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.cleaned_documents(none).count() == 0
    assert got(line_dedup.dedup_lines(clashing)) == brute([r[:2] for r in rows])
    assert line_dedup.cleaned_documents(clashing).columns == clashing.columns
