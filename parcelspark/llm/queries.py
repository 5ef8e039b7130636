"""The registered queries of this subpackage and their SQL, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver does, if it isn't installed; elsewhere the entry does nothing.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import kdtree

    rows = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(rows, rows.where("vec_id % 50 = 0"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import resample

    return resample.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import common, tokens

    # A fresh cache for each call: the query gives the same figures however often it ran before.
    return tokens.count_tokens(table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), pattern())


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import quality

    return quality.quality(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import mixing

    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import bpe, common

    return bpe.encode_docs(table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.tiktoken"), pattern(), with_ids=False)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filters": op10_url_filters,
}

#: Brute force over all rows. What the other queries return can't be written in SQL; tests hold them against other versions.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
