"""The queries of this package, each an operator applied to its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe_codec, conversation_repair, decontamination, licenses, lm_scoring, ngram_join, oracles, phrases, quality, secrets, sharding, token_counts, token_shards, toxicity
from webloom.llm.common import table, tokenizer_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_join, op3_minimax_shards, op4_license_scan, op5_token_shards, op6_quality_rules, op7_secret_scan, op8_token_counts, op9_toxicity, op10_bpe_codec, op11_conversation_repair, op12_lm_scoring, op13_phrases)}
#: Tokenizers, learned models and randomness tests have no SQL form; tests hold those queries against plain versions.
ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.NGRAM_JOIN,
    "op3_minimax_shards": oracles.MINIMAX_SHARDS,
    "op4_license_scan": oracles.license_scan(licenses.PHRASES, licenses.TEMPLATES),
    "op6_quality_rules": oracles.quality_rules(quality.STRATA, quality.RULES, quality.GRID),
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_phrases": oracles.PHRASES,
}
