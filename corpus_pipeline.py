"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's docs.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns a row of
token ids for each row of the mix. Null texts, repeated rows and empty tables pass through as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm import bpe, common, mixing, pii, quality, simhash
from parcelspark.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that fail the base limits or lose too much go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind's name in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with hashes of the ids and of the bytes they decode to."""
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    out = bpe.encode_docs(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: No SQL for pigeonring components, the seeded mix or BPE; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_cut(done)  # the stage after it reads the new one
    return STAGES[-1][1](spark, docs, sf_dir)
