"""Counts, probes, masks, health reports, words and concepts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rating import eff_mu
from ..operators import census, geometry, lexical
from ..streaming import incremental
from . import world
from .edge_queries import _EFF, _NOT_REFUTED, _hex
from .registry import query
from .world import entity, rated, sql, table, type_id


@query(sql(f"SELECT type_id, relation, count(*) AS relations, CAST(sum(witness_count) AS BIGINT) AS witnesses, max({_EFF}) AS top_eff_mu FROM consensus GROUP BY ALL"))
def arena_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(census.arena_counts(rated(spark, sf_dir)))


@query(sql(f"""placed AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rank * {_EFF} / 1e9 DESC, subject_id, type_id, object_id) AS place FROM consensus WHERE {_NOT_REFUTED} AND band IN ('taxonomic', 'partitive', 'causal', 'associative'))
SELECT band, place, subject_id, object_id, rating FROM placed WHERE place <= 5"""))
def band_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = census.band_leaders(rated(spark, sf_dir), ["taxonomic", "partitive", "causal", "associative"])
    return _hex(rows.select("band", F.col("place").cast("long").alias("place"), "subject_id", "object_id", "rating"))


@query(sql(f"""v AS (SELECT subject_id, CASE WHEN rating + 2 * rd < 1500000000000 THEN 'refuted' WHEN {_EFF} > 1500000000000 THEN 'confirmed' WHEN volatility > 90000000 THEN 'contested' ELSE 'thin' END AS v FROM consensus)
SELECT subject_id, count(*) FILTER (v = 'confirmed') AS confirmed, count(*) FILTER (v = 'contested') AS contested, count(*) FILTER (v = 'refuted') AS refuted, count(*) FILTER (v = 'thin') AS thin FROM v GROUP BY subject_id"""))
def entity_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(census.entity_record(world.counted(spark, sf_dir)))


_SOURCES = "ev AS (SELECT md5('substrate/source/' || o_orderpriority || '/v1') AS source_id, md5('customer:' || o_custkey) AS subject_id, md5('part:' || l_partkey) AS object_id, md5('order:' || o_orderkey) AS context_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.evidence(spark, sf_dir).filter(F.col("type_id") == F.lit(type_id("ORDERED")))


@query(f"WITH {_SOURCES} SELECT coalesce(e.source_id, c.source_id) AS source_id, coalesce(evidence, 0) AS evidence, coalesce(content, 0) AS content FROM (SELECT source_id, count(*) AS evidence FROM ev GROUP BY source_id) e FULL JOIN (SELECT source_id, count(DISTINCT object_id) AS content FROM ev GROUP BY source_id) c USING (source_id)")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    return _hex(census.source_counts(e, e.select("source_id", F.col("object_id").alias("entity_id"))))


@query(f"WITH {_SOURCES} SELECT count(*) AS n FROM (SELECT subject_id FROM ev GROUP BY subject_id HAVING count(DISTINCT source_id) > 1)")
def multi_source_entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.multi_source_entities(_orders(spark, sf_dir))


@query(f"WITH {_SOURCES} SELECT count(*) AS n FROM ev WHERE source_id = md5('substrate/source/1-URGENT/v1')")
def evidence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.evidence_count(_orders(spark, sf_dir), source_id=entity("substrate/source/1-URGENT/v1"))


@query("SELECT CAST(o_orderkey - 1 AS BIGINT) AS idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def present_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("idx"), F.col("o_orderkey").alias("id"))
    stored = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return census.present_ordinals(wanted, stored, ["id"])


@query("SELECT CAST(floor(s_suppkey / 32) AS BIGINT) AS word, bit_or(CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) THEN (1::BIGINT << CAST(s_suppkey % 32 AS INTEGER)) ELSE 0::BIGINT END) AS bits FROM supplier GROUP BY 1")
def exist_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 32 of a word's bits are used, as the SQL's shifts are signed
    wanted = table(spark, sf_dir, "supplier").select((F.floor(F.col("s_suppkey") / 32) * 64 + F.col("s_suppkey") % 32).alias("idx"), F.col("s_suppkey").alias("id"))
    stored = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").alias("id"))
    return census.bitmap(wanted, stored, ["id"])


_BIT = "CASE relation WHEN 'IS_A' THEN 0 WHEN 'IN_NATION' THEN 1 WHEN 'IN_REGION' THEN 2 WHEN 'SUPPLIES' THEN 3 WHEN 'ORDERED' THEN 4 WHEN 'HAS_BRAND' THEN 5 END"


@query(sql(f"""ends AS (SELECT subject_id AS id, {_BIT} AS bit FROM consensus UNION SELECT object_id, {_BIT} FROM consensus)
SELECT id, bit_or(1::BIGINT << bit) AS mask0, CAST(count(DISTINCT bit) AS INTEGER) AS popcount, array_to_string(list_sort(list(DISTINCT bit)), ',') AS bits, bool_or(bit IN (3, 4)) AS trades FROM ends GROUP BY id"""))
def entity_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = census.entity_masks(rated(spark, sf_dir))
    trade = F.array(F.lit(24).cast("long"), *[F.lit(0).cast("long")] * 3)
    return _hex(masks.select("id", F.col("mask")[0].alias("mask0"), census.mask_popcount().cast("int").alias("popcount"), F.concat_ws(",", F.transform(census.mask_bits(), lambda x: x.cast("string"))).alias("bits"), census.mask_match("mask", trade).alias("trades")))


@query(sql("SELECT relation, count(*) AS \"rows\", round(count(*) / (SELECT count(*) FROM consensus), 9) AS share FROM consensus GROUP BY relation"))
def partition_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.partition_pressure(rated(spark, sf_dir), "relation").withColumn("share", F.round("share", 9))


@query(sql(f"""links AS (SELECT subject_id AS word, object_id AS concept, {_EFF} AS mu FROM consensus WHERE relation = 'HAS_BRAND' AND {_NOT_REFUTED}),
p AS (SELECT a.word, b.word AS peer, count(DISTINCT concept) AS shared, max(least(a.mu, b.mu)) AS strength FROM links a JOIN links b USING (concept) WHERE a.word <> b.word GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY shared DESC, strength DESC, peer) AS place FROM p)
SELECT word, peer, shared, strength FROM placed WHERE place <= 3"""))
def concept_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir, ["HAS_BRAND"])
    words = c.select(F.col("subject_id").alias("word"))
    return _hex(lexical.concept_peers(c, words, [type_id("HAS_BRAND")], 3))


@query(sql(f"""links AS (SELECT subject_id AS word, object_id AS synset, {_EFF} AS mu, witness_count AS witnesses FROM consensus WHERE relation = 'IN_NATION' AND {_NOT_REFUTED}),
lang AS (SELECT md5('customer:' || c_custkey) AS word, c_mktsegment AS lang FROM customer),
r AS (SELECT a.word, b.word AS other, lb.lang AS language, max(b.mu) AS mu, CAST(sum(b.witnesses) AS BIGINT) AS witnesses FROM links a JOIN lang la ON la.word = a.word JOIN links b USING (synset) JOIN lang lb ON lb.word = b.word WHERE a.word <> b.word AND la.lang <> lb.lang GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY mu DESC, language, other) AS place FROM r)
SELECT word, other, language, mu, witnesses FROM placed WHERE place <= 6"""))
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "customer").select(ids.canonical_id(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("word"), F.col("c_mktsegment").alias("lang"))
    return _hex(lexical.translations(world.counted(spark, sf_dir), lang, [type_id("IN_NATION")], lang, limit=6))


@query(sql(f"""links AS (SELECT subject_id AS word, object_id AS concept, {_EFF} AS mu FROM consensus WHERE relation = 'IN_NATION' AND {_NOT_REFUTED}), lang AS (SELECT md5('customer:' || c_custkey) AS word, c_mktsegment AS lang FROM customer)
SELECT concept, count(DISTINCT lang) AS languages, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS reply, max(mu) AS mu FROM links JOIN lang USING (word) GROUP BY concept"""))
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "customer").select(ids.canonical_id(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("word"), F.col("c_mktsegment").alias("lang"))
    c = world.counted(spark, sf_dir)
    return _hex(lexical.language_coverage(c, c.select(F.col("object_id").alias("concept")), [type_id("IN_NATION")], lang))


@query(sql(f"""senses AS (SELECT subject_id AS term, object_id AS sense_id, {_EFF} AS mu FROM consensus WHERE relation = 'ORDERED' AND {_NOT_REFUTED}),
ups AS (SELECT subject_id AS sense_id, object_id AS synset_id FROM consensus WHERE relation = 'IS_A' AND {_NOT_REFUTED}),
r AS (SELECT term, sense_id, coalesce(synset_id, sense_id) AS synset_id, mu / 1e9 AS score FROM senses LEFT JOIN ups USING (sense_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, sense_id, synset_id) AS place FROM r)
SELECT term, sense_id, synset_id, round(score, 6) AS score FROM placed WHERE place <= 5"""))
def bubble_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    terms = c.filter(F.col("type_id") == F.lit(type_id("ORDERED"))).select(F.col("subject_id").alias("term"))
    rows = lexical.bubble_up(c, terms, [type_id("ORDERED")], [type_id("IS_A")], k=5)
    return _hex(rows.select("term", "sense_id", "synset_id", F.round("score", 6).alias("score")))


@query(sql("SELECT max(rd) AS widest, min(rd) AS narrowest, count(DISTINCT type_id) AS kinds, count(DISTINCT subject_id) AS subjects FROM consensus"))
def placement_of_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.counted(spark, sf_dir).agg(F.max("rd").alias("widest"), F.min("rd").alias("narrowest"), F.countDistinct("type_id").alias("kinds"), F.countDistinct("subject_id").alias("subjects"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), geometry.point(*[F.col("embedding")[k] for k in range(4)]).alias("coord"), "label")


_PTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS m, label FROM embeddings)"


@query(f"WITH {_PTS} SELECT id, round(sqrt(x*x + y*y + z*z + m*m), 9) AS radius, round(x / sqrt(x*x + y*y + z*z + m*m), 9) AS ux FROM pts")
def direction_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", F.round(geometry.radius_origin("coord"), 9).alias("radius"), F.round(geometry.direction("coord")["x"], 9).alias("ux"))


@query(f"""WITH {_PTS}, d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) + (a.m-b.m)*(a.m-b.m)) AS distance FROM pts a JOIN pts b ON a.id < b.id)
SELECT a, b, round(distance, 9) AS distance FROM d WHERE distance <= 0.05""")
def dwithin_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pairs_within(_points(spark, sf_dir), 0.05).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_PTS}, u AS (SELECT id, x / r AS x, y / r AS y, z / r AS z, m / r AS m FROM (SELECT *, sqrt(x*x + y*y + z*z + m*m) AS r FROM pts) WHERE r > 0),
d AS (SELECT q.id AS qid, p.id, sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) + (q.m-p.m)*(q.m-p.m)) AS distance FROM u q JOIN u p ON q.id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), id) AS place FROM d)
SELECT qid, id, place, round(distance, 9) AS distance FROM placed WHERE place <= 10""")
def nearest_neighbors_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    rows = geometry.nearest(p, p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "coord"), 10)
    return rows.select("qid", "id", F.col("place").cast("long").alias("place"), F.round("distance", 9).alias("distance"))


@query(f"WITH {_PTS} SELECT label, count(*) AS \"rows\", round(min(sqrt(x*x + y*y + z*z + m*m)), 9) AS min_r, round(max(sqrt(x*x + y*y + z*z + m*m)), 9) AS max_r, count(*) FILTER (abs(sqrt(x*x + y*y + z*z + m*m) - 1) > 1e-9) AS off_sphere FROM pts GROUP BY label")
def placement_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.placement_health(_points(spark, sf_dir), "label")
    return rows.select("label", "rows", F.round("min_r", 9).alias("min_r"), F.round("max_r", 9).alias("max_r"), "off_sphere")


@query()
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _points(spark, sf_dir).withColumn("coord", geometry.direction("coord")).filter("coord is not null")
    return _hex(geometry.with_hilbert(unit).select("id", "hilbert_index"))


@query()
def curve_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frechet and Hausdorff distances of each label's curve to the next label's."""
    curves = geometry.curve(_points(spark, sf_dir), "label", "id", "coord")
    pairs = curves.join(curves.select((F.col("label") - 1).alias("label"), F.col("curve").alias("other")), "label")
    out = geometry.curve_distance(geometry.curve_distance(pairs, "curve", "other", "frechet", "frechet"), "curve", "other", "hausdorff", "hausdorff")
    return out.select("label", "frechet", "hausdorff")


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS events FROM n GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.windowed(rows, "ts", ["event_type"], "1 hour", n=lambda: F.count("*"), total=lambda: F.round(F.sum("value"), 4))
    return out.select("event_type", F.col("window.start").alias("hour"), "n", "total")


@query(sql(f"SELECT subject_id, type_id, object_id, {_EFF} AS eff_mu_fp FROM consensus WHERE relation = 'IS_A'"))
def consensus_export_relations_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = world.counted(spark, sf_dir).filter(F.col("type_id") == F.lit(type_id("IS_A")))
    return _hex(own.select("subject_id", "type_id", "object_id", eff_mu().alias("eff_mu_fp")))


@query("""SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_prompt, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def session_last_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_prompt"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
