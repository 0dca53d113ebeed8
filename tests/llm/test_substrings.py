import hashlib

from conftest_llm import SF, WORD, collected
from strikeflow.llm import substrings as S
from strikeflow.llm.queries import QUERIES


def brute(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def hashed(rows):
    return sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in rows), key=repr)


def test_report(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = QUERIES["op8_substring_dedup"](spark, SF)
    assert collected(df, *df.columns) == hashed(brute(rows))


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    df = S.substring_report(odd)
    assert collected(df, *df.columns) == hashed(want)
    assert sum(g for _, _, g, _ in want) > 5000
    got = S.substring_dedup(odd)
    assert got.columns == odd.columns
    changed = {(i, t) for i, _, g, t in want if g}
    assert changed <= {(r.doc_id, r.text) for r in got.collect()}
    assert len(got.collect()) == len(rows)


def test_branches_between_overlapping_sources(spark):
    # every document shares parts with several others, at other offsets
    import random

    rng = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        w = []
        while len(w) < 150:
            at = rng.randrange(len(pool) - 30)
            w += pool[at : at + rng.randint(5, 90)]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(g for _, _, g, _ in want) > 500
    got = S.substring_report(df)
    assert collected(got, *got.columns) == hashed(want)


def test_repeating_texts(spark):
    rows = [(i, "a b " * n) for i, n in enumerate((20, 25, 60, 26, 300))] + [(9, "c " * 70), (8, "c " * 49), (10, "c " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.substring_report(df)
    assert collected(got, *got.columns) == hashed(brute(rows))


def test_empty(empty):
    assert S.substring_report(empty).count() == 0 and S.substring_dedup(empty).count() == 0


def test_spans_of_repeated_rows_are_listed_once(spark):
    from strikeflow.llm.shared import Scratch

    passage = [f"w{i}" for i in range(90)]
    texts = [" ".join(passage), " ".join(["x"] + passage[:70]), " ".join(passage[5:] + ["y"] * 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 20, "doc_id long, text string").repartition(4)
    spans = {r.id: [tuple(s) for s in r.spans] for r in S.repeated_spans(df, Scratch(spark, "t")).collect()}
    assert set(spans) == {1, 2} and all(len(s) == len(set(s)) for s in spans.values())
    assert {(r.doc_id, r.text) for r in S.substring_dedup(df).collect()} == {(0, texts[0]), (1, "x"), (2, " ".join(["y"] * 60))}
