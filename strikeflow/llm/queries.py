"""The registered queries of this package; each takes (spark, sf_dir)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_report
from .extraction import extraction_report
from .lines import line_dedup_report
from .mixing import mix_report
from .parsing import fingerprint_report
from .pieces import piece_report
from .quality import quality_report
from .repair import repair_report
from .shared import table
from .simhash import near_dedup_report
from .spelling import spelling_report
from .sql import CHAT, LINES, QUALITY, REPAIR, SPELLING, SUBSTRINGS, TOPK
from .substrings import substring_report
from .tokenfile import token_file_report
from .topk import top_k_report


def tokenizer_file(name: str) -> str:
    """A vocabulary file: in $TOKENIZER_DIR, or of the installed public_tokenizers."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_report(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_report(table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_report(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_locally_consistent_parsing,
        op2_line_dedup,
        op3_sentencepiece,
        op4_chat_formatting,
        op5_quality_rules,
        op6_simhash_near_dedup,
        op7_html_extraction,
        op8_substring_dedup,
        op9_entropy_balancing,
        op10_token_files,
        op11_spelling_variants,
        op12_exact_top_k,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": LINES,
    "op4_chat_formatting": CHAT,
    "op5_quality_rules": QUALITY,
    "op8_substring_dedup": SUBSTRINGS,
    "op11_spelling_variants": SPELLING,
    "op12_exact_top_k": TOPK,
    "op13_conversation_repair": REPAIR,
}
