"""Exact top-k against brute force."""

import math
import random

import pytest
from conftest_llm import SF

from strikeflow.llm.topk import top_k, top_k_report

SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, query long, rank int, block int, _q int, _norm int"


def floored(v, scale=1024):
    import numpy as np

    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute(rows, k=10, every=100):
    taken = [(r[0], floored(r[1])) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, (a, q) in enumerate(taken):
        if a is None or a % every:
            continue
        near = [(-sum(x * y for x, y in zip(q, c)), b is None, b or 0) for j, (b, c) in enumerate(taken) if j != i]
        out += [(a, n, None if missing else b, -s) for n, (s, missing, b) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(vectors):
    return [(i, v, 0, 7, "x", 5, 6, 8, 9, 10) for i, v in vectors]


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(top_k_report(df)) == brute(rows) != []


def test_odd_rows(spark):
    rng = random.Random(1)
    v = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    same = v()
    vectors = [(i, v()) for i in range(0, 230)]
    vectors += [(300, None), (400, []), (500, [1.0, None]), (600, [math.nan] * 6), (700, [math.inf] + [0.0] * 5), (800, [0.0] * 6)]
    vectors += [(900, v(9)), (1000, v(2)), (-100, v()), (None, v()), (None, same), (100, vectors[100][1]), (100, v())]
    vectors += [(i, same) for i in range(2000, 2060)]  # more ties than k
    vectors += [(2000, same), (3000, [float(2**12)] * 3)]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    assert got(top_k_report(df)) == brute(vectors)


def test_large_components_stay_exact(spark):
    vectors = [(100 * i, [float(2**17 + i), float(2**18 - i), 1.0]) for i in range(30)] + [(1, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(rows_of(vectors[:-1]), SCHEMA)
    assert got(top_k_report(df)) == brute(vectors[:-1])
    with pytest.raises(OverflowError):
        top_k_report(spark.createDataFrame(rows_of(vectors), SCHEMA))


def test_few_and_no_rows(spark):
    assert got(top_k_report(spark.createDataFrame([], SCHEMA))) == []
    one = [(100, [0.5, 0.5])]
    assert got(top_k_report(spark.createDataFrame(rows_of(one), SCHEMA))) == []
    few = one + [(3, [1.0, 0.0]), (2, [1.0, 0.0])]
    assert got(top_k_report(spark.createDataFrame(rows_of(few), SCHEMA))) == [(100, 1, 2, 512 * 1024), (100, 2, 3, 512 * 1024)]
    assert got(top_k_report(spark.createDataFrame(rows_of(few[1:]), SCHEMA))) == []


def test_blocks_of_queries(spark, monkeypatch):
    from strikeflow.llm import topk

    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3)
    assert got(top_k(df, df.vec_id % 10 == 0, 3)) == brute(vectors, 3, 10)
