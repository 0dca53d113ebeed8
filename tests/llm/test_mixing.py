import math

import numpy as np
import pytest
from conftest_llm import SF, WORD
from strikeflow.llm import mixing as M
from strikeflow.llm.queries import QUERIES


def test_water_fill():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 0}
    got = M.water_fill(sizes, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}, 1110)
    assert got["a"] == 30 and got["b"] == 300 and got["c"] == pytest.approx(780) and got[None] == 0
    assert sum(M.water_fill({"a": 1}, {"a": 1.0}, 100).values()) == 3


def test_weights_by_code_point_null_last():
    assert M.cycle_weights([None, "b", "a", "é", "Z"]) == {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}


def check(docs, rows):
    by = {}
    for r in docs.collect():
        by.setdefault(r.source, []).append(len(WORD.findall(r.text or "")))
    sizes = {s: sum(v) for s, v in by.items()}
    targets = M.water_fill(sizes, M.cycle_weights(list(sizes)), sum(sizes.values()))
    assert len(rows) == sum(map(len, by.values()))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for s, sized in by.items():
        own = [r for r in rows if r.source_size == sizes[s] and r.target == pytest.approx(targets[s])]
        taken = sum(r.taken for r in own)
        assert abs(taken - targets[s]) <= max(sized)


def test_report(spark):
    df = QUERIES["op9_entropy_balancing"](spark, SF)
    check(spark.read.parquet(f"{SF}/documents.parquet"), df.collect())
    again = QUERIES["op9_entropy_balancing"](spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows(odd):
    check(odd, M.mix_report(odd).collect())


def test_rates_solve_the_dual(spark):
    sizes = [10, 20, 20, 40, 400]
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = M.mix(docs, weights={"s": 1.0}, total=700).collect()
    rates = {r["size"]: r.rate for r in rows}
    assert sum(n * rates[n] for n in sizes) == pytest.approx(700, rel=1e-5)
    # exponential in the size below the cap
    slope = math.log(rates[40]) / 40
    for n in (10, 20, 400):
        assert rates[n] == pytest.approx(min(3, math.exp(slope * n)), rel=1e-6)
    assert all(r.copies in (0, 1, 2, 3) for r in rows)


def test_equal_documents_share_copies(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(1000)], "doc_id long, text string, source string")
    copies = [r.copies for r in M.mix(docs, weights={"s": 1.0}, total=14_000).collect()]
    assert sum(copies) == 1400 and set(copies) == {1, 2}


def test_rows_come_as_often_as_taken(odd):
    got = M.mix_rows(odd)
    assert got.columns == odd.columns
    want = sum(r.copies for r in M.mix(odd).collect())
    assert got.count() == pytest.approx(want, abs=3)


def test_empty(empty):
    assert M.mix_report(empty).count() == 0 and M.mix_rows(empty).count() == 0


def test_blank_texts_only(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in M.mix_report(docs).collect()] == [0, 0]
    assert np.isfinite([r.target for r in M.mix_report(docs).collect()]).all()


def test_a_target_that_is_not_reached_raises(spark):
    hist = spark.createDataFrame([("s", 10, 1), ("s", 1000, 1)], "source string, size long, n long")
    sizes, docs, targets = {"s": 1010}, {"s": 2}, {"s": 37.0}
    assert M.solve_rates(hist, sizes, docs, targets)["s"] < 0
    with pytest.raises(ArithmeticError):
        M.solve_rates(hist, sizes, docs, targets, steps=1)


def test_a_source_of_weight_zero_is_left_out(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "a b c", "t")], "doc_id long, text string, source string")
    assert {r.id: r.copies for r in M.mix(docs.withColumnRenamed("doc_id", "id"), weights={"s": 1.0, "t": 0.0}, id="id").collect()} == {1: 2, 2: 0}
