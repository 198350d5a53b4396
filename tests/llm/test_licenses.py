import re

import pytest

from tessera.llm import licenses

NC = "Licensed under CC BY-NC 4.0."


def brute(text, t=0.8):
    text = text or ""
    parts = re.split(r"\n[\x20\x09-\x0D]*\n", text)
    units = text.split("\n") + [p for p in parts if "\n" in p]
    hits = []
    for u in units:
        w = "".join(c if c.isalnum() else " " for c in u.lower()).split()
        g = {f"{a} {b}" for a, b in zip(w, w[1:])}
        found = [(-2 * len(g & set(b)) / (len(g) + len(b)), i) for i, x in licenses.TEMPLATES for b in [licenses.template_bigrams(x)] if g and 2 * len(g & set(b)) / (len(g) + len(b)) >= t]
        if found:
            hits.append(min(found))
    return len(hits), min(hits)[1] if hits else None, -min(hits)[0] if hits else 0.0, ",".join(sorted({h[1] for h in hits}))


def texts():
    out = [None, "", " \n\n ", "no license here", NC, NC.upper() + "\n" + NC, f"some words\n  {NC}\nmore", "Licensed under CC BY 4.0.", "All rights reserved.", "all   RIGHTS, reserved", "Licensed under the Apache License Version 2", "a a a a a a a a a a", "Äll rïghts"]
    out += [t for _, t in licenses.TEMPLATES]
    out += [t.replace(" ", "\n", 3) for _, t in licenses.TEMPLATES]
    out += [f"{t} and one more" for _, t in licenses.TEMPLATES] + ["\n\n".join(t for _, t in licenses.TEMPLATES), "x " * 40_000 + "\n" + NC]
    return out


def got(df):
    return sorted((r.doc_id, r.n_matches, r.license, round(r.dice, 9), r.licenses) for r in df.collect())


def test_texts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = [(i, n, x, round(d, 9), every) for i, t in rows for n, x, d, every in [brute(t)]]
    assert got(licenses.scan_licenses(df)) == expect


def test_every_template_finds_itself():
    for i, t in licenses.TEMPLATES:
        n, best, dice, _ = brute(t)
        assert n >= 1 and dice == 1.0 and best == i


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_thresholds(spark, threshold):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    expect = [brute(t, threshold)[0] for t in texts()]
    assert [r.n_matches for r in licenses.scan_licenses(df, threshold).orderBy("doc_id").collect()] == expect


def test_no_python_no_shuffle(docs):
    plan = licenses.scan_licenses(docs.select("*"))._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rows_and_clashing_names(none, clashing, docs):
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(clashing).count() == docs.count()
