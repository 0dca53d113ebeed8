import sys

import corpus_pipeline as C
from conftest_llm import SF, WORD
from strikeflow.llm import pieces
from test_lines import brute as lines
from test_quality import brute as quality
from test_simhash import brute as groups

from strikeflow.llm.queries import tokenizer_file
from strikeflow.llm.shared import Scratch


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece_encoding"]


def walk(spark, docs):
    scratch, seen = Scratch(spark, "test"), [docs]
    for name, stage in C.STAGES:
        docs = scratch.stage(stage(spark, docs, SF), name)
        seen.append(docs)
    return seen


def check(seen):
    given, good, deduped, single, mixed, encoded = ([r.asDict() for r in df.collect()] for df in seen)
    pair = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    assert pair(good) == sorted(((r["doc_id"], r["text"]) for r in given if quality(r["text"])[-1]), key=repr)
    assert pair(deduped) == sorted(((i, t) for i, _, _, t in lines([(r["doc_id"], r["text"]) for r in good])), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in deduped)
    want = {c for _, _, c in groups([(r["doc_id"], r["text"]) for r in deduped])}
    assert {r["doc_id"] for r in single} == want and len(single) == len(want)
    assert {r["doc_id"] for r in mixed} <= want and len(mixed) <= 3 * len(single)
    size = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
    assert abs(size(mixed) - size(single)) <= 0.1 * size(single) + max(len(WORD.findall(r["text"])) for r in single)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r["ids"] == sp.encode(r["text"]) and r["n_tokens"] == len(r["ids"])
    for a, b in zip(seen[:-1], seen[1:-1]):
        assert a.columns == b.columns


def test_documents(spark):
    check(walk(spark, spark.read.parquet(f"{SF}/documents.parquet")))


def test_odd_rows(spark, odd, empty):
    check(walk(spark, odd))
    assert all(df.count() == 0 for df in walk(spark, empty))


def test_run(spark):
    got = C.run(spark, SF)
    assert got.columns[-2:] == ["ids", "n_tokens"] and got.count() > 0


def test_entry_without_the_package():
    """__spark_entry__ imports without these folders, and does not hide other errors."""
    import subprocess

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ('corpus_pipeline', 'strikeflow.llm'):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'monthly_value' in e.queries() and not any(n.startswith('op') for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=C.__file__.rsplit("/", 1)[0])
