"""Queries that put texts together from their parts, and more reads of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census, realize
from . import world
from .census_queries import _SOURCES, _orders
from .edge_queries import _EFF, _hex
from .registry import query
from .world import entity, sql, table, type_id


def _compositions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of conversations as compositions of tokens, tokens as compositions of characters: links, atoms, roots."""
    turns = table(spark, sf_dir, "conversations").filter("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("parent"), "text")
    tokens = turns.select("parent", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\s+|\S+)"), 1)).alias("ordinal", "child"))
    chars = tokens.select(F.concat(F.lit("w:"), "child").alias("parent"), "child").distinct().select("parent", F.posexplode(F.split("child", "")).alias("ordinal", "c")).filter("c <> ''")
    links = tokens.select("parent", "ordinal", F.concat(F.lit("w:"), "child").alias("child"), F.lit(1).alias("run")).unionByName(chars.select("parent", "ordinal", F.concat(F.lit("c:"), "c").alias("child"), F.lit(1).alias("run")))
    atoms = chars.select(F.concat(F.lit("c:"), "c").alias("id"), F.col("c").alias("text")).distinct()
    return links, atoms, turns.select(F.col("parent").alias("id"))


@query("SELECT DISTINCT conv_id || ':' || turn AS id, md5(text) AS digest FROM conversations WHERE text <> ''")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realize.render_text(*_compositions(spark, sf_dir), max_depth=4).select("id", F.md5("text").alias("digest"))


@query("SELECT 'c:' || c AS id, count(*) AS refs FROM (SELECT DISTINCT t, unnest(range(length(t))) AS i, t[i + 1] AS c FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\s+|\\S+')) AS t FROM conversations WHERE text <> '')) GROUP BY c ORDER BY refs DESC, id LIMIT 50")
def render_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, atoms, _ = _compositions(spark, sf_dir)
    chars = links.filter("child like 'c:%'")
    return realize.render_gaps(chars, atoms.limit(0))


@query(f"WITH {_SOURCES.replace(' GROUP BY ALL)', ')')}, e AS (SELECT subject_id, object_id, context_id, count(*) AS observation_count FROM ev WHERE source_id = md5('substrate/source/2-HIGH/v1') GROUP BY ALL) SELECT subject_id, object_id, observation_count FROM e ORDER BY observation_count DESC, subject_id, object_id, context_id LIMIT 40")
def source_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = census.source_roster(_orders(spark, sf_dir), entity("substrate/source/2-HIGH/v1"))
    return _hex(rows.select("subject_id", "object_id", "observation_count"))


@query(sql(f"""pairs AS (SELECT md5('nation:' || c_nationkey) AS a, md5('customer:' || c_custkey) AS b FROM customer UNION ALL SELECT md5('nation:99'), md5('customer:' || c_custkey) FROM customer)
SELECT a, b, round(greatest(coalesce(max({_EFF} / 1e9), 0), 0), 3) AS score FROM pairs LEFT JOIN consensus ON relation = 'IN_NATION' AND ((subject_id = a AND object_id = b) OR (subject_id = b AND object_id = a)) GROUP BY a, b"""))
def eval_pair_plane_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ids import canonical_id

    c = table(spark, sf_dir, "customer")
    b = canonical_id(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("b")
    pairs = c.select(canonical_id(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).alias("a"), b).union(c.select(canonical_id(F.lit("nation:99")).alias("a"), b))
    rows = census.pair_plane_score(world.counted(spark, sf_dir), pairs, type_id("IN_NATION"))
    return _hex(rows.select("a", "b", F.round("score", 3).alias("score")))
