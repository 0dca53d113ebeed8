"""From raw documents to token ids: the corpus pipeline.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and works on
all that the one before has kept.  All but the last return the columns of
``documents``.  A null text counts as empty, and such documents go in the first
stage; repeated rows are near copies of each other, of which one stays; an empty
table stays empty; further columns of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import pieces
from strikeflow.llm.lines import line_dedup
from strikeflow.llm.mixing import mix_rows
from strikeflow.llm.quality import quality_filter
from strikeflow.llm.queries import tokenizer_file
from strikeflow.llm.shared import Scratch, table
from strikeflow.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    kept = line_dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: some not at all, some up to three times."""
    return mix_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts, ``ids``, and their number, ``n_tokens``."""
    encoded = pieces.encode(docs, pieces.load(tokenizer_file("piece_bpe_32k.model")))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece_encoding", encode_pieces),
]

#: SQL can't express the fingerprints' bits, the balanced rates or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
