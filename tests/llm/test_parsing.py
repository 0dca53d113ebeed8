import hashlib
import random

import numpy as np
from conftest_llm import SF, collected
from strikeflow.llm import parsing as P
from strikeflow.llm.queries import QUERIES


def check(rows, got, next_of_ties=False):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + nxt[:n]
        own, new, after = P.sketches([text, changed, nxt])
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), P.to_string(own), P.to_string(new), P.likeness(own[None], new[None])[0], P.likeness(own[None], after[None])[0]))
    assert sorted(want, key=repr) == collected(got, *got.columns)


def test_report(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, QUERIES["op1_locally_consistent_parsing"](spark, SF))


def test_odd_rows(odd):
    check([(r.doc_id, r.text or "") for r in odd.collect()], P.fingerprint_report(odd))


def test_one_document(spark):
    df = spark.createDataFrame([(5, "abcdef" * 50)], "doc_id long, text string")
    check([(5, "abcdef" * 50)], P.fingerprint_report(df))


def test_sketches_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab c", k=rng.randint(0, 900))) for _ in range(60)] + ["", "a", "aa", "a" * 5000, "é😀" * 90]
    alone = np.concatenate([P.sketches([t]) for t in texts])
    assert (P.sketches(texts) == alone).all()


def test_phrases_agree_inside_equal_substrings():
    rng = random.Random(2)
    middle = "".join(rng.choices("abcdefgh ", k=4000))
    for head in ("", "x", "some other beginning ", "".join(rng.choices("abc ", k=777))):
        a = np.frombuffer(middle.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        b = np.frombuffer((head + middle + head).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        for _ in range(3):
            a, _t = P._phrases(a, np.zeros(len(a), np.int32))
            b, _t = P._phrases(b, np.zeros(len(b), np.int32))
            assert len(set(a.tolist()) - set(b.tolist())) <= 8


def test_likeness_follows_the_shared_part():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    x, y = (" ".join(word() for _ in range(2000)) for _ in range(2))
    near = lambda a, b: P.likeness(*np.split(P.sketches([a, b]), 2))[0]
    assert near(x, x) == 1 and near(x, y) < 0.05 and near("", "") == 1 and near("", x) == 0
    assert near(x, "Prefix: " + x) > 0.85
    assert 0.3 < near(x, x[: len(x) * 2 // 3] + y[: len(x) // 3]) < 0.7


def test_equal_texts_have_equal_fingerprints(odd, empty):
    got = {}
    for r in P.fingerprint_documents(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 20:
            got.setdefault(r.text, set()).add(r.fingerprint)
    assert P.fingerprint_documents(odd).count() == odd.count()
    assert P.fingerprint_report(empty).count() == 0


def test_likeness_does_not_depend_on_the_length():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))[:n]
    near = lambda a, b: P.likeness(*np.split(P.sketches([a, b]), 2))[0]
    for _ in range(20):
        text = prose(405)
        assert near(text, text[:395]) > 0.6 and near(text, prose(395)) < 0.1


def test_edited_form_under_400_characters(spark):
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(90))[:450]
    df = spark.createDataFrame([(2, text), (1, "")], "doc_id long, text string")
    near = {r.doc_id: r.near_edited for r in P.fingerprint_report(df).collect()}
    assert near[2] > 0.4 and near[1] == 1


def test_cuts_are_ids_and_nearly_even(spark):
    # most ids close together, a few far away
    ids = spark.range(0, 30_000).selectExpr("if(id < 29000, id * 3, id * 1000000000000) AS id")
    edges, all_ids = P._edges(ids, 40), np.sort([r.id for r in ids.collect()])
    assert set(edges.tolist()) <= set(all_ids.tolist()) and edges[-1] == all_ids[-1]
    assert np.bincount(np.searchsorted(edges, all_ids), minlength=len(edges)).max() < 4 * len(all_ids) / 40
    assert "percentile" not in P.neighbours(ids.selectExpr("id AS doc_id", "'' AS text"))._jdf.queryExecution().toString()
    assert len(P._edges(ids.limit(0), 40)) == 0
