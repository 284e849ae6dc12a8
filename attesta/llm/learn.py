"""What the learned scorers share: a bounded sample of labelled rows and one task that fits a model to it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most rows documents with a label of 0 or 1, those whose ids have the smallest hashes.

    A document whose id has several labels counts with the largest one. The labels alone are cut to the bound, before
    any text is read, so the side that is sent to all tasks has no more than rows ids.
    """
    ids = ensure_columns(labels, **{"doc_id": "long", label: "int"}).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    # twice the bound, as some labelled ids may have no document
    picked = ids.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    texts = ensure_columns(docs, doc_id="long", text="string").filter("text is not null")
    both = texts.join(F.broadcast(picked), "doc_id")
    return both.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).select("text", "label")


def fitted(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """What fit makes of the whole sample, in one task on an executor; the sample's bound keeps that task small."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([fit(table)], pa.binary())})

    rows = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").collect()
    return bytes(rows[0].model) if rows else b""
