"""The registered queries of this package: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellvote.llm import (
    bpe,
    conversations,
    decontamination,
    html_text,
    language_id,
    merkle,
    minhash,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    token_files,
    url_filter,
)
from cellvote.llm.common import read
from cellvote.settings import new_table_path

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2


def byte_bpe() -> str:
    """Path of the vocabulary; the module that knows it is needed by the queries on tokens only."""
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache = new_table_path(spark, "token-cache")
    return token_counts.token_counts(read(spark, sf, "documents"), byte_bpe(), cache)


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf, "documents"), byte_bpe(), path, END_ID)
    return token_files.checksums(token_files.read_token_files(spark, path))


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(read(spark, sf, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.span_rows(suffix_dedup.passages(read(spark, sf, "documents")))


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled(spark))
    return url_filter.judge(read(spark, sf, "pages"), model)


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf, "documents"), byte_bpe())


def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf, "documents"))


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(read(spark, sf, "documents"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damage(read(spark, sf, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(read(spark, sf, "documents"))


QUERIES = [
    op1_token_counts,
    op2_decontamination,
    op3_token_files,
    op4_html_text,
    op5_quality_rules,
    op6_sharding,
    op7_suffix_dedup,
    op8_url_filter,
    op9_bpe,
    op10_minhash,
    op11_language_id,
    op12_conversation_repair,
    op13_merkle_manifest,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.ORACLE_SQL,
        "op6_sharding": sharding.ORACLE_SQL,
        "op12_conversation_repair": conversations.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
