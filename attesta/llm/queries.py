"""The queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, mixing, pitman_yor, quality, sentencepiece_codec, suffix_dedup, token_files, topk, toxicity
from .common import crc32_mod, documents

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = token_files.export(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=(3, 1))
    return scored.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "worst", "worst_begin", "worst_end")


@_query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.search(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


#: Integer scores make the SQL exact; list_reduce would be slower than unnesting both vectors.
ORACLES["op9_top_k"] = """
WITH sound AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(langid.learnable(docs)))
    return found.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.round("prob", 9).alias("prob"), "kept")


ORACLES["op7_mixing"] = mixing.oracle_sql()


@_query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(documents(spark, sf_dir), sweeps=pitman_yor.SWEEPS)
