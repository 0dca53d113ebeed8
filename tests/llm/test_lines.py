import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from conftest_llm import LOWER, collected
from pyspark.sql import functions as F

from strikeflow.llm import lines as L
from strikeflow.llm.shared import quiet_conf
from strikeflow.llm.sql import LINES


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_docs=10):
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    got = L.line_dedup_report(odd)
    assert sorted(want, key=repr) == collected(got, *got.columns)
    assert any(d for _, _, d, _ in want)


def test_columns_stay_and_texts_change(odd):
    got = L.line_dedup(odd, min_docs=3)
    assert got.columns == odd.columns
    want = sorted(((i, t) for i, _, _, t in brute([(r.doc_id, r.text) for r in odd.collect()], 3)), key=repr)
    assert collected(got, "doc_id", "text") == want


def test_runs_settle_over_batches_and_levels(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(((i, t) for i, _, _, t in brute(rows, 4)), key=repr)
    for batches in (1, 3, 9):
        assert collected(L.line_dedup(odd, min_docs=4, batches=batches), "doc_id", "text") == want


def test_settled_hashes_do_not_enter_again(spark):
    runs = L.LineRuns(spark, min_docs=2, fan_out=9)
    batch = spark.createDataFrame([(1, 1), (2, 2)], "a long, b long")
    sizes = []
    for n in (1, 2, 2, 2):
        runs.add(batch.limit(n))
        sizes.append(runs.runs()[-1].count())
    assert sizes == [1, 2, 1, 0]
    assert sorted(map(tuple, runs.finish().collect())) == [(1, 1), (2, 2)]


@pytest.mark.parametrize(("fan_out", "min_docs"), [(2, 1), (2, 3), (3, 5), (4, 12)])
def test_settled_after_every_batch(spark, fan_out, min_docs):
    rng = random.Random(fan_out)
    runs = L.LineRuns(spark, min_docs, fan_out)
    seen = Counter()
    for n in (40, 0, 3, 90, 40, 1):
        batch = [(a, a % 3 - 1) for a in (int(rng.paretovariate(0.6)) % 60 - 30 for _ in range(n))]
        seen.update(batch)
        runs.add(spark.createDataFrame(batch, "a long, b long"))
        assert all(len(level) < fan_out for level in runs.levels.values())
        want = sorted(k for k, c in seen.items() if c >= min_docs)
        assert sorted(map(tuple, runs.settled().collect())) == want
    assert sorted(map(tuple, runs.finish().collect())) == want


def test_runs_merge_without_a_shuffle_or_a_sort(spark):
    runs = L.LineRuns(spark, min_docs=3, fan_out=9)
    rows = spark.range(1000).select((F.col("id") % 70).alias("a"), (F.col("id") % 7).alias("b"))
    for _ in range(3):
        runs.add(rows)
    with quiet_conf(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        merged = plan(L.LineRuns._merged(*runs.runs()[:2]))
        assert "SortMergeJoin" in merged and "Exchange" not in merged and "Sort [" not in merged
        # a new batch is shuffled and sorted, once; the three runs it meets are not
        fresh = plan(runs._fresh(rows))
        assert [len(re.findall(x, fresh)) for x in ("SortMergeJoin", r"Exchange hash", r"Sort \[")] == [3, 1, 1]


def test_repeated_ids_are_documents_of_their_own(spark):
    rows = [(7, "shared line\nown line")] * 6 + [(7, "Shared line \nother")] * 4 + [(8, f"rare {i}") for i in range(3)]
    got = L.line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cur = con.execute(LINES)
    assert collected(got, *(d[0] for d in cur.description)) == sorted(cur.fetchall(), key=repr)
    assert sum(r.n_dropped for r in got.collect()) == 10


def test_shuffled_hashes_give_the_same(odd):
    few = L.frequent_places(odd, min_docs=3)
    many = L.frequent_places(odd, min_docs=3, broadcast_hashes=0)
    sort = lambda df: sorted(((r.id, r.t, sorted(r.found)) for r in df.collect()), key=repr)
    assert sort(few) == sort(many) != []


def test_empty(empty):
    assert L.line_dedup(empty).count() == 0 and L.line_dedup_report(empty).count() == 0


def test_places_of_repeated_rows_are_listed_once(spark):
    text = "\n".join(f"line {i % 3}" for i in range(6))
    df = spark.createDataFrame([(1, text)] * 30 + [(None, text)] * 30, "doc_id long, text string").repartition(4)
    assert [sorted(r.found) for r in L.frequent_places(df).collect()] == [list(range(6))] * 2
    assert {(r.doc_id, r.text) for r in L.line_dedup(df).collect()} == {(1, ""), (None, "")}
