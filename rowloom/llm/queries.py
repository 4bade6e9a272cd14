"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import chat, dedup, language, neighbours, packing, quality, sampling, secrets, token_counts, warc

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op4_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), k=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=1024, end_id=2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), minimum=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # it uses this package, so it is imported when it runs

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_ann_search": op3_ann_search,
    "op4_sp_sampling": op4_sp_sampling,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op10_warc_round_trip": op10_warc_round_trip,
    "pipeline": pipeline,
}

#: Eight groups of five hex digits (20 bits) make four base32 letters each.
_BASE32 = "list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '')"

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": dedup.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_chat_format": chat.SQL,
    "op10_warc_round_trip": f"""
        WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
        e AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, MIN(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM e""",
}
