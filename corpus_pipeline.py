"""A training-data pipeline over documents: each stage's rows are written as Parquet and read again as the next one's."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import jaccard_join, langid, mixing, sentencepiece_codec, suffix_dedup
from attesta.llm.common import documents, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the models learn from those that aren't held out."""
    return langid.accepted(docs, langid.train(langid.learnable(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal or near copies; rows that share a doc_id are one document, and
    rows without one stay, as nothing names them."""
    gone = jaccard_join.join_documents(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that an earlier one has; what has nothing left goes."""
    left = suffix_dedup.remove_repeats(docs, texts=True).filter("not (n_removed > 0 and text = '')")
    kinds = dict(docs.dtypes)
    return left.withColumn("n_chars", F.length("text")).select(*[F.col(c).cast(kinds[c]) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come near the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_words=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Character models, joins by similarity and tokenizers can't be said in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
