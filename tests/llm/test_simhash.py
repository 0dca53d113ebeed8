import re

import numpy as np
import xxhash
from conftest_llm import LOWER, SF, WORD
from strikeflow.llm import simhash as H
from strikeflow.llm.queries import QUERIES
from strikeflow.llm.shared import Scratch, quiet_conf


def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=repr)


def test_golay_code_is_perfect():
    patterns, number = H.golay_tables()
    assert np.bincount(number).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    assert len({int(p) for p, n in zip(patterns, number) for p in p[:n]}) == 277 + 6 * 1771


def test_two_bits_share_a_key():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for bits in (0, 1, 2):
        near = fps.copy()
        for i in range(len(near)):
            for b in rng.choice(64, bits, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        keys = [set() for _ in fps], [set() for _ in fps]
        for out, x in zip(keys, (fps, near)):
            for r, k in zip(*H.fuzzy_keys(x)):
                out[r].add(int(k))
        assert all(a & b for a, b in zip(*keys))


def test_report(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op6_simhash_near_dedup"](spark, SF).collect()), key=repr) == brute(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in H.near_dedup_report(odd).collect()), key=repr) == want
    kept = H.near_dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, _, c in want}


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 1 << 62))
    near = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (200, 2))}
    chain = [center ^ (0b111 << 40 << i) ^ (1 << 60) for i in range(3)]
    fps = sorted(near | set(chain))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.fp: r.root for r in H.fingerprint_components(df, Scratch(spark, "test")).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_long_chain_settles(spark):
    from strikeflow.llm.components import components

    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    got = {r.node: r.root for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def test_empty(empty):
    assert H.near_dedup_report(empty).count() == 0 and H.near_dedup(empty).count() == 0


def test_components_that_share_an_id_keep_a_row_each(spark):
    one, two = "the quick brown fox jumps over the lazy dog", "an entirely different text about rivers and mills"
    df = spark.createDataFrame([(5, one), (5, two), (6, one), (7, two), (None, "some words without any id"), (None, "some words without any id")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in H.near_dedup(df).collect()), key=repr)
    assert kept == [(5, two), (5, one), (None, "some words without any id")]


def test_texts_move_once(spark):
    rows = [(i % 50, f"some words of text {i % 25} and some more") for i in range(200)] + [(None, "no id")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    with quiet_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = H.near_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    assert "Exchange" not in plan[:join]
    # one shuffle of the texts below the join, by its own key
    assert len(re.findall(r"Exchange hashpartitioning\(_none#\w+, _id#\w+, _t#\w+", plan)) == 2
    left = plan[join : plan.index("Exchange hashpartitioning(_none", plan.index("Exchange hashpartitioning(_none") + 1)]
    assert len(re.findall("Exchange hash", left)) == 1 and "SortAggregate" in left
