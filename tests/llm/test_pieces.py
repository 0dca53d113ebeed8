import random

import pytest
import regex
from conftest_llm import SF
from strikeflow.llm import pieces as P
from strikeflow.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
ALPHABET = [*"abcdethe Th.,1 \n\t\rñéß中文  ▁'-", "the", "ing", " ", "😀", "́", "क", "ा", " "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_segments_equal_the_library(library):
    rng, model = random.Random(1), P.load(PATH)
    find = regex.compile(model.unit).findall
    for _ in range(5000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 30)))
        ids = [i for u in find(P.spaced(text)) for i in P.segment(u, model)]
        assert ids == library.encode(text), repr(text)
        assert P.decode_ids(ids, model) == library.decode(ids)


def test_lattice_equals_the_library(spark, library):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))) for i in range(400)] + [(500, "a" * P.LONG), (501, "x" * 4000), (502, "中" * P.LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.piece_report(df, PATH).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: library.encode(t) for i, t in rows}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())


def test_report(spark, library):
    got = {r.doc_id: r for r in QUERIES["op3_sentencepiece"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].ids == library.encode(r.text or "") and got[r.doc_id].round_trip


def test_odd_rows(odd, empty, library):
    model = P.load(PATH)
    encoded = P.encode(odd, model)
    assert encoded.columns == [*odd.columns, "ids"]
    rows = sorted(((r.doc_id, r.text, library.encode(r.text or "")) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.text, r.ids) for r in encoded.collect()), key=repr) == rows
    back = P.decode(encoded, model)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back.collect())
    assert P.encode(empty, model).count() == 0


def best_score(unit, pieces, low):
    score = [0.0]
    for e in range(1, len(unit) + 1):
        score.append(max([score[s] + pieces[unit[s:e]][1] for s in range(e) if unit[s:e] in pieces] + [score[e - 1] + low] * (unit[e - 1] not in pieces)))
    return score[-1]


def test_unigram_lattice_finds_the_best_path(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)} | {"a", "b", "c", P.SPACE})
    pieces = {p: (i + 1, -rng.uniform(1, 9)) for i, p in enumerate(names)}
    model = P.make_model("unigram", pieces, (None, *names))
    low = min(s for _, s in pieces.values()) - 10
    units = sorted({"".join(rng.choices("abcabcx", k=rng.randint(1, 14))) for _ in range(300)})
    got = {r.unit: r.ids for r in P.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    score = {i: s for i, s in pieces.values()} | {0: low}
    for u in units:
        for ids in (got[u], P.segment(u, model)):
            assert sum(score[i] for i in ids) == pytest.approx(best_score(u, pieces, low))
            assert "".join(names[i - 1] if i else "x" for i in ids) == u


def test_memory_bound_of_the_units(spark):
    from pyspark.sql import functions as F

    model = P.load(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_part", F.pmod("doc_id", F.lit(3)))
    all_at_once, in_parts = (P._units_of(docs, "text", model, n).distinct() for n in (10**9, 50))
    assert all_at_once.count() > 1000 and all_at_once.exceptAll(in_parts).isEmpty() and in_parts.exceptAll(all_at_once).isEmpty()


def test_models_too_large_for_the_packing_raise():
    with pytest.raises(ValueError):
        P.make_model("bpe", {"a": (1 << 20, 0.0), "b": (2, 0.0)})


def test_nothing_is_shuffled_and_words_can_be_forgotten(odd, library, monkeypatch):
    model = P.load(PATH)
    plan = P.encode(odd.coalesce(2), model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    for name, value in (("WORDS_TOGETHER", 7), ("CHARS_TOGETHER", 100), ("UNITS_TOGETHER", 3), ("CELLS", 50)):
        monkeypatch.setattr(P, name, value)
    got = P.encode(odd.coalesce(2), model).select("text", "ids").collect()
    assert len(got) == odd.count() and all(r.ids == library.encode(r.text or "") for r in got)


def test_lost_order_raises(spark):
    import pyarrow as pa

    rows = {"_row": [0, 0, 2], "_unit": ["ab", None, "c"], "_edge": [None, 5, None]}
    types = [("_row", pa.int64()), ("_unit", pa.string()), ("_edge", pa.int64())]
    with pytest.raises(ValueError):
        list(P._folds(iter([pa.RecordBatch.from_pydict(rows, pa.schema(types))]), P.load(PATH)))


def test_texts_of_many_lists():
    import pyarrow as pa

    rng, model = random.Random(4), P.load(PATH)
    lists = [rng.choices([-1, *range(400), 31999, 32000, 10**6], k=rng.randint(0, 40)) for _ in range(300)]
    assert P._texts(pa.array(lists, pa.list_(pa.int32())), model, P._spelling(model)) == [P.decode_ids(x, model) for x in lists]
    assert P._texts(pa.array([[]], pa.list_(pa.int32())), model, P._spelling(model)) == [""]
