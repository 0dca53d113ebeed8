"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import LOWER, SF, collected

from strikeflow.llm import spelling
from strikeflow.llm.spelling import spelling_report, spelling_variants, word_counts

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(rows, slip=199):
    total = Counter()
    for id_, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words):
    out, form = [], {}
    alike = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(alike[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(alike[w]), words.get(form[w])))
    return sorted(out, key=repr)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    want = brute(words)
    assert collected(spelling_report(docs), *COLUMNS) == want
    assert any(r[1] for r in want)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert collected(spelling_report(odd), *COLUMNS) == brute(counted(rows))


def test_empty(spark, empty):
    assert collected(spelling_report(empty), *COLUMNS) == []


@pytest.mark.parametrize("subtree", [100_000, 9])
def test_dense_words(spark, monkeypatch, subtree):
    """Few letters, so that many words are near; chains of forms; long and empty words; subtrees in parts."""
    monkeypatch.setattr(spelling, "SUBTREE", subtree)
    rng = random.Random(4)
    words = {"".join(rng.choices("abÀé", k=rng.randint(0, 6))): rng.choice([5, 5, 25, 30, 125, 700, 5 * 10**9]) for _ in range(400)}
    words |= {"q" * 3000: 5, "q" * 2999: 25, "q" * 1500 + "r" + "q" * 1499: 125, "chain": 1, "chaini": 5, "chainin": 25, "chaining": 125, "chainings": 125}
    words = dict(sorted(words.items()))
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [(None, 3, "x", 1)], "word string, n long, key string, part int").repartition(4)
    want = brute(words)
    assert collected(spelling_variants(df), *COLUMNS) == want
    assert max(r[4] for r in want) > 10 and ("chain", "chaini", "chainings", 1, 1, 5) not in want


def test_planted_slips(spark):
    rows = [(i, "Überall spelling ÀÉ× variant") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(collected(word_counts(docs), "word", "n")) == counted(rows)
    assert len(counted(rows, 7)) > 3 and dict(collected(word_counts(docs, slip=7), "word", "n")) == counted(rows, 7)
