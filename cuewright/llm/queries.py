"""The registered queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import chat_format, language_id, quality_rules, secrets, toxicity
from cuewright.llm.common import holdout_bucket, read_table
from cuewright.llm.decontaminate import contaminated
from cuewright.llm.near_dedup import near_duplicates
from cuewright.llm.sentencepiece_codec import encode_decode
from cuewright.llm.sharding import shard_by_bytes
from cuewright.llm.token_files import WordBpe, token_files

END_ID = 2
TOXIC_SCORE = 0.3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out():
    return F.coalesce(holdout_bucket(F.col("doc_id")) == 2, F.lit(False))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=8)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render_chats(read_table(spark, sf_dir, "conversations"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), WordBpe(tokenizer_path("word_bpe_49k.json")), END_ID)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_sharding,
        op2_chat_format,
        op3_token_files,
        op4_quality_rules,
        op5_secrets,
        op6_language_id,
        op7_sentencepiece,
        op8_decontamination,
        op9_minhash_near_dedup,
        op10_toxicity,
    )
}

#: DuckDB SQL for the queries that SQL can express at a bearable cost.
ORACLES: dict[str, str] = {"op2_chat_format": chat_format.ORACLE, "op4_quality_rules": quality_rules.ORACLE}
