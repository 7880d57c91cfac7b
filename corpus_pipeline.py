"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a
DataFrame: the rows it keeps, or for the last stage a row of token figures for each document. Rows
with null or empty texts pass every filter; the last stage gives them no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import secrets, toxicity
from cuewright.llm.common import read_table, written
from cuewright.llm.decontaminate import decontaminated
from cuewright.llm.near_dedup import deduplicated
from cuewright.llm.queries import TOXIC_SCORE, tokenizer_path
from cuewright.llm.sentencepiece_codec import encode_decode


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below the limit."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, TOXIC_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, and ``n_chars`` brought up to date where a text changed."""
    return secrets.redacted(docs, length_col="n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's SentencePiece ids, and whether they decode to its text."""
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: The stages' models and tokenizers are beyond SQL; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
