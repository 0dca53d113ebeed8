"""Extra columns named like the operators' own pass through."""

import pytest
from conftest_llm import collected
from pyspark.sql import functions as F

from strikeflow.llm.lines import line_dedup
from strikeflow.llm.mixing import mix_rows
from strikeflow.llm.pieces import encode, load
from strikeflow.llm.queries import tokenizer_file
from strikeflow.llm.simhash import near_dedup
from strikeflow.llm.substrings import substring_dedup

NAMES = ("_h", "_id", "_t", "_n", "_part", "_row", "_kept", "_spans", "_copies", "_Key", "_rank", "kept0")

OPERATORS = {
    "line_dedup": line_dedup,
    "near_dedup": near_dedup,
    "substring_dedup": substring_dedup,
    "mix_rows": mix_rows,
    "encode": lambda docs: encode(docs, load(tokenizer_file("piece_bpe_32k.model"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_underscored_columns(spark, name):
    rows = [(i, f"line of {i % 7} words here\nshared line\nthe end {i}", ["s1", "s2", None][i % 3]) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    more = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in NAMES})
    want, got = OPERATORS[name](plain), OPERATORS[name](more)
    assert [c for c in got.columns if c in more.columns] == more.columns
    assert collected(got, *want.columns) == collected(want, *want.columns)
    for r in got.collect():
        assert all(r[c] == f"{c}:{r.doc_id}" for c in NAMES)
