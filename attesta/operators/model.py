"""Schemas of the stored tables, the relation law, and the folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import tomllib
import uuid

from pyspark.sql import DataFrame, SparkSession

EVIDENCE = "id binary, subject_id binary, type_id binary, object_id binary, source_id binary, context_id binary, outcome short, last_observed_at timestamp, observation_count long, sum_score_fp long, opponent_rd_fp long"
CONSENSUS = "id binary, subject_id binary, type_id binary, object_id binary, rating long, rd long, volatility long, witness_count long, last_observed_at timestamp"
ENTITIES = "id binary, tier short, type_id binary, first_observed_by binary, created_at timestamp, mask array<long>"
TRAJECTORIES = "entity_id binary, phys_type short, coord struct<x:double,y:double,z:double,m:double>, points array<struct<child:binary,ordinal:int,run:int,ctier:int>>"
RELATION_LAW = "relation string, band string, rank double, bit int, symmetric boolean"

#: Ranks of the bands of relations; fixed values.
BAND_RANKS = {
    "mandate": 1.0,
    "definitional": 0.97,
    "taxonomic": 0.90,
    "equivalence": 0.82,
    "partitive": 0.73,
    "causal": 0.64,
    "oppositional": 0.45,
    "associative": 0.36,
    "tensor_calculation": 0.27,
    "lexical_glue": 0.18,
    "scalar_valued": 0.12,
    "standards_structural": 0.08,
    "probationary": 0.05,
}


def relation_law(spark: SparkSession, relations: dict[str, str], symmetric: set[str] = frozenset()) -> DataFrame:
    """The dimension of relations (name to band), each with its band's rank and a bit of its own."""
    from ..functions.ids import relation_type_id

    rows = [(r, b, BAND_RANKS[b], i, r in symmetric) for i, (r, b) in enumerate(relations.items())]
    return spark.createDataFrame(rows, RELATION_LAW).withColumn("type_id", relation_type_id("relation"))


def read_relation_law(spark: SparkSession, path: str) -> DataFrame:
    """A law in TOML: one table `relations` of name = {band = ..., symmetric = ...}, read through Spark."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = tomllib.loads(text)["relations"]
    return relation_law(spark, {k: v["band"] for k, v in found.items()}, {k for k, v in found.items() if v.get("symmetric")})


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a temporary one if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that loops don't grow their plans or repeat their work."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
