"""Queries that read rated edges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import shown
from ..functions.rating import belief_logit, edge_rank, eff_mu, eff_mu_display, edge_strength, outcome, refuted, score, score_inverse, walk_edge_weight, weight
from ..operators import edges, fold
from . import world
from .registry import query
from .world import entity, rated, sql, type_id

_EFF = "(rating - 2 * rd)"
_NOT_REFUTED = "rating + 2 * rd >= 1500000000000"
_STRENGTH = "(1 / (1 + exp(-(1 / sqrt(1 + 3 * (rd / 173717800000.0) * (rd / 173717800000.0) / 9.869604401)) * (rating - 1500000000000) / 173717800000.0)))"
_RANKED = f"rank * {_EFF} / 1e9"


def _subjects(spark: SparkSession, sf_dir: str, kind: str, table: str, key: str) -> DataFrame:
    from ..functions.ids import canonical_id

    return world.table(spark, sf_dir, table).select(canonical_id(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))).alias("subject_id"))


def _hex(df: DataFrame) -> DataFrame:
    return df.select(*[shown(c).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes])


@query(sql(f"SELECT subject_id, type_id, object_id, round({_RANKED}, 6) AS edge_rank, witness_count FROM consensus WHERE {_NOT_REFUTED} ORDER BY {_RANKED} DESC, subject_id, type_id, object_id LIMIT 50"))
def top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges.top_relations(rated(spark, sf_dir), 50)
    return _hex(rows.select("subject_id", "type_id", "object_id", F.round(edge_rank(), 6).alias("edge_rank"), "witness_count"))


_ARMS = """arms AS (
    SELECT r.id AS root, 'out' AS direction, object_id AS neighbour_id, type_id, rank, rating, rd, witness_count FROM consensus JOIN roots r ON subject_id = r.id
    UNION ALL SELECT r.id, 'in', subject_id, type_id, rank, rating, rd, witness_count FROM consensus JOIN roots r ON object_id = r.id WHERE subject_id <> r.id)"""


@query(sql(f"""roots AS (SELECT md5('part:' || p_partkey) AS id FROM part), {_ARMS},
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY {_RANKED} DESC, neighbour_id, type_id, CASE direction WHEN 'out' THEN 0 ELSE 1 END) AS place FROM arms WHERE {_NOT_REFUTED})
SELECT root, direction, neighbour_id, type_id, rating, rd, witness_count FROM placed WHERE place <= 12"""))
def edges_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges.edges_raw(rated(spark, sf_dir), _subjects(spark, sf_dir, "part", "part", "p_partkey"), limit=12)
    return _hex(rows.select("root", "direction", "neighbour_id", "type_id", "rating", "rd", "witness_count"))


@query(sql(f"""placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {_EFF} DESC, object_id, type_id) AS place FROM consensus)
SELECT subject_id, type_id, object_id, rating, rd, witness_count FROM placed WHERE place <= 5"""))
def consensus_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    return _hex(edges.consensus_out(c, c, 5).select("subject_id", "type_id", "object_id", "rating", "rd", "witness_count"))


@query(sql(f"""placed AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {_EFF} DESC, subject_id, type_id) AS place FROM consensus)
SELECT subject_id, type_id, object_id, rating, rd, witness_count FROM placed WHERE place <= 5"""))
def consensus_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    return _hex(edges.consensus_in(c, c, 5).select("subject_id", "type_id", "object_id", "rating", "rd", "witness_count"))


@query(sql(f"""own AS (SELECT *, ({_EFF} - 1500000000000) / 1e9 / (400.0 / ln(10.0)) AS logit FROM consensus WHERE relation = 'ORDERED'),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY subject_id)) AS e FROM own),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY subject_id) AS p, row_number() OVER (PARTITION BY subject_id ORDER BY {_EFF} DESC, object_id) AS place FROM e)
SELECT subject_id, object_id, round(p, 6) AS p, round(logit, 6) AS logit, rd, witness_count FROM p WHERE place <= 20"""))
def belief_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    rows = edges.belief_distribution(c, c, [type_id("ORDERED")], 20)
    return _hex(rows.select("subject_id", "object_id", F.round("p", 6).alias("p"), F.round("logit", 6).alias("logit"), "rd", "witness_count"))


@query(sql(f"""best AS (SELECT object_id, subject_id, max({_EFF}) AS mu FROM consensus WHERE {_NOT_REFUTED} GROUP BY ALL)
SELECT object_id, CAST(count(*) AS INTEGER) AS support, CAST(sum(mu) AS BIGINT) AS total_mu FROM best WHERE subject_id IN (SELECT md5('customer:' || c_custkey) FROM customer) GROUP BY object_id ORDER BY support DESC, total_mu DESC, object_id LIMIT 40"""))
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(edges.shared_objects(world.counted(spark, sf_dir), _subjects(spark, sf_dir, "customer", "customer", "c_custkey")))


@query(sql(f"SELECT subject_id, type_id, object_id, CASE WHEN rating + 2 * rd < 1500000000000 THEN 'refuted' WHEN {_EFF} > 1500000000000 THEN 'confirmed' WHEN volatility > 90000000 THEN 'contested' ELSE 'thin' END AS verdict FROM consensus"))
def epistemic_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(edges.epistemic_status(world.counted(spark, sf_dir)).select("subject_id", "type_id", "object_id", "verdict"))


@query(sql(f"SELECT subject_id, type_id, object_id, rating, rd, witness_count, {_EFF} AS eff_mu FROM consensus WHERE band = 'causal' AND {_NOT_REFUTED} ORDER BY {_EFF} DESC, subject_id, type_id, object_id LIMIT 1000"))
def band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges.band_edges(rated(spark, sf_dir), "causal")
    return _hex(rows.select("subject_id", "type_id", "object_id", "rating", "rd", "witness_count", eff_mu().alias("eff_mu")))


@query(sql(f"SELECT subject_id, type_id, object_id, {_EFF} / 1e9 AS eff_mu FROM consensus WHERE band IN ('taxonomic', 'partitive') AND {_EFF} / 1e9 >= 900"))
def distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(edges.distill(rated(spark, sf_dir), ["taxonomic", "partitive"], 900.0).select("subject_id", "type_id", "object_id", "eff_mu"))


@query(sql(f"""ids AS (SELECT subject_id AS id FROM consensus WHERE relation IN ('IN_NATION', 'IN_REGION', 'IS_A') UNION SELECT object_id FROM consensus WHERE relation IN ('IN_NATION', 'IN_REGION', 'IS_A')),
w AS (SELECT subject_id, object_id, sum(rank * (2 * {_STRENGTH} - 1)) AS w, max(rank) AS layer_rank FROM consensus WHERE subject_id IN (SELECT id FROM ids) AND object_id IN (SELECT id FROM ids) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(w, 9) DESC, object_id) AS place FROM w)
SELECT subject_id, object_id, round(w, 6) AS w, layer_rank FROM placed WHERE place <= 64"""))
def consensus_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rated(spark, sf_dir)
    own = e.filter(F.col("relation").isin("IN_NATION", "IN_REGION", "IS_A"))
    vocab = own.select(F.col("subject_id").alias("id")).union(own.select("object_id"))
    return _hex(edges.vocab_plane(e, vocab, 64).select("subject_id", "object_id", F.round("w", 6).alias("w"), "layer_rank"))


@query(sql(f"SELECT object_id AS brand_id, CAST(count(DISTINCT subject_id) AS BIGINT) AS parts, round(avg({_STRENGTH}), 9) AS strength, min(2 * {_STRENGTH} - 1) > 0 AS all_positive FROM consensus WHERE relation = 'HAS_BRAND' GROUP BY object_id"))
def brand_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rated(spark, sf_dir).filter("relation = 'HAS_BRAND'")
    return _hex(own.groupBy(F.col("object_id").alias("brand_id")).agg(F.countDistinct("subject_id").alias("parts"), F.round(F.avg(edge_strength()), 9).alias("strength"), (F.min(walk_edge_weight()) > 0).alias("all_positive")))


@query(sql(f"SELECT subject_id, object_id, round({_EFF} / 1e9, 3) AS conservative, round({_RANKED}, 6) AS salience, round(2 * {_STRENGTH} - 1, 6) AS complete, round({_STRENGTH}, 6) AS strength FROM consensus WHERE relation = 'SUPPLIES'"))
def weight_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rated(spark, sf_dir).filter("relation = 'SUPPLIES'")
    return _hex(own.select("subject_id", "object_id", F.round(weight("conservative"), 3).alias("conservative"), F.round(weight("salience"), 6).alias("salience"), F.round(weight("complete"), 6).alias("complete"), F.round(weight("strength"), 6).alias("strength")))


@query("SELECT event_id, CAST(round(0.5 * (1 + value / (50.0 + abs(value))) * 1e9) AS BIGINT) AS score_fp FROM events WHERE value IS NOT NULL")
def score_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.table(spark, sf_dir, "events").filter("value is not null").select("event_id", score("value", 50.0).alias("score_fp"))


@query("""WITH s AS (SELECT event_id, CAST(round(0.5 * (1 + value / (50.0 + abs(value))) * 1e9) AS BIGINT) AS f FROM events WHERE value IS NOT NULL)
SELECT event_id, round(50.0 * (2 * f / 1e9 - 1) / (1 - abs(2 * f / 1e9 - 1)), 3) AS value_again FROM s""")
def score_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = world.table(spark, sf_dir, "events").filter("value is not null").withColumn("f", score("value", 50.0))
    return rows.select("event_id", F.round(score_inverse("f", 50.0), 3).alias("value_again"))


@query(sql(f"""pairs AS (SELECT md5('supplier:' || l_suppkey) AS subject_id, md5('part:' || l_partkey) AS object_id FROM lineitem GROUP BY ALL),
placed AS (SELECT c.*, row_number() OVER (PARTITION BY c.subject_id, c.object_id ORDER BY {_EFF} DESC, type_id) AS place FROM consensus c JOIN pairs USING (subject_id, object_id))
SELECT subject_id, object_id, type_id, rating, witness_count FROM placed WHERE place = 1"""))
def classify_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ids import canonical_id

    lines = world.table(spark, sf_dir, "lineitem")
    pairs = lines.select(canonical_id(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))).alias("subject_id"), canonical_id(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("object_id"))
    return _hex(edges.classify_circuit(rated(spark, sf_dir), pairs).select("subject_id", "object_id", "type_id", "rating", "witness_count"))


@query(sql(f"""pairs AS (SELECT row_number() OVER (ORDER BY c_custkey) AS ord, md5('customer:' || c_custkey) AS subject_id, md5('nation:' || (c_custkey % 25)) AS object_id FROM customer)
SELECT ord, round(coalesce({_EFF} / 1e9, 0), 3) AS score FROM pairs LEFT JOIN (SELECT * FROM consensus WHERE relation = 'IN_NATION') c USING (subject_id, object_id)"""))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions.ids import canonical_id

    customers = world.table(spark, sf_dir, "customer")
    pairs = customers.select(F.row_number().over(Window.orderBy("c_custkey")).cast("long").alias("ord"), canonical_id(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("subject_id"), canonical_id(F.concat(F.lit("nation:"), (F.col("c_custkey") % 25).cast("string"))).alias("object_id"))
    return edges.pair_scores(world.counted(spark, sf_dir), pairs, type_id("IN_NATION")).select("ord", F.round("score", 3).alias("score"))


@query(sql("SELECT DISTINCT subject_id FROM consensus WHERE relation = 'SUPPLIES'"))
def subjects_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(edges.subjects_of_type(world.counted(spark, sf_dir), type_id("SUPPLIES")))


@query(sql("""near AS (SELECT k, n FROM (SELECT 'a' AS k, object_id AS n FROM consensus WHERE subject_id = md5('customer:1') UNION ALL SELECT 'a', subject_id FROM consensus WHERE object_id = md5('customer:1')
    UNION ALL SELECT 'b', object_id FROM consensus WHERE subject_id = md5('customer:2') UNION ALL SELECT 'b', subject_id FROM consensus WHERE object_id = md5('customer:2')))
SELECT count(*) AS shared FROM (SELECT n FROM near GROUP BY n HAVING count(DISTINCT k) = 2)"""))
def usage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.usage_overlap(world.counted(spark, sf_dir), entity("customer:1"), entity("customer:2"))


@query(sql(f"""both_ways AS (SELECT subject_id AS a, object_id AS b, type_id, subject_id, rating, rd FROM consensus WHERE relation = 'IN_NATION' AND {_NOT_REFUTED}),
placed AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY {_EFF} DESC, type_id, subject_id) AS place FROM both_ways)
SELECT b AS a, a AS b, type_id, subject_id, rating FROM placed WHERE place = 1"""))
def step_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    pairs = c.filter(F.col("type_id") == F.lit(type_id("IN_NATION"))).select(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))
    return _hex(edges.step_edge(c, pairs).select("a", "b", "type_id", "subject_id", "rating"))


@query(sql("""subjects AS (SELECT md5('part:' || p_partkey) AS subject_id FROM part), wanted AS (SELECT md5(r) AS type_id FROM (VALUES ('IS_A'), ('HAS_BRAND'), ('SUPPLIES')) t(r))
SELECT subject_id, type_id FROM subjects CROSS JOIN wanted WHERE (subject_id, type_id) NOT IN (SELECT (subject_id, type_id) FROM consensus)"""))
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(bytearray(type_id(r)),) for r in ("IS_A", "HAS_BRAND", "SUPPLIES")], "type_id binary")
    return _hex(edges.gaps(world.counted(spark, sf_dir), _subjects(spark, sf_dir, "part", "part", "p_partkey"), expected))


@query(sql("""ev AS (SELECT DISTINCT subject, relation, object FROM said)
SELECT CAST((SELECT count(*) FROM consensus) AS BIGINT) AS consensus_rows, round(avg(witness_count), 6) AS avg_witnesses, max(witness_count) AS max_witnesses FROM consensus"""))
def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    out = edges.stats(c, c)
    return out.select("consensus_rows", F.round("avg_witnesses", 6).alias("avg_witnesses"), "max_witnesses")


@query(sql(f"""c AS (SELECT md5('part:' || p_partkey) AS candidate FROM part), f AS (SELECT md5('supplier:' || s_suppkey) AS covered FROM supplier),
e AS (SELECT candidate, covered, rank * (2 * {_STRENGTH} - 1) AS w FROM consensus JOIN c ON subject_id = candidate JOIN f ON object_id = covered
    UNION ALL SELECT candidate, covered, rank * (2 * {_STRENGTH} - 1) FROM consensus JOIN c ON object_id = candidate JOIN f ON subject_id = covered)
SELECT candidate, round(sum(w) * ln(1 + count(DISTINCT covered)), 6) AS steer, count(*) AS edges, count(DISTINCT covered) AS covered FROM e GROUP BY candidate"""))
def steer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _subjects(spark, sf_dir, "part", "part", "p_partkey").withColumnRenamed("subject_id", "id")
    suppliers = _subjects(spark, sf_dir, "supplier", "supplier", "s_suppkey").withColumnRenamed("subject_id", "id")
    out = edges.steer_candidates(rated(spark, sf_dir), parts, suppliers)
    return _hex(out.select("candidate", F.round("steer", 6).alias("steer"), "edges", "covered"))


_EVIDENCE = """WITH said AS (
    SELECT md5('customer:' || o_custkey) AS subject_id, md5('part:' || l_partkey) AS object_id, md5('substrate/source/' || o_orderpriority || '/v1') AS source_id, md5('order:' || o_orderkey) AS context_id,
        CAST(round((1 - 5 * l_discount) * 1e9) AS BIGINT) AS score_fp, l_shipdate AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT md5(unhex(subject_id) || unhex(md5('ORDERED')) || unhex(object_id) || unhex(source_id) || unhex(context_id)) AS id, subject_id, object_id, source_id, count(*) AS observation_count, CAST(sum(score_fp) AS BIGINT) AS sum_score_fp,
    CAST(CASE WHEN 2 * sum(score_fp) > count(*) * 1000000000 THEN 2 WHEN 2 * sum(score_fp) < count(*) * 1000000000 THEN 0 ELSE 1 END AS SMALLINT) AS outcome
FROM said GROUP BY subject_id, object_id, source_id, context_id"""


@query(_EVIDENCE)
def observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = world.evidence(spark, sf_dir).filter(F.col("type_id") == F.lit(type_id("ORDERED")))
    return _hex(rows.select("id", "subject_id", "object_id", "source_id", "observation_count", "sum_score_fp", "outcome"))


@query(name="consensus_fold")
def consensus_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(fold.fold(world.evidence(spark, sf_dir)).select("id", "subject_id", "type_id", "object_id", "rating", "rd", "volatility", "witness_count"))


@query()
def scoped_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ids import source_id

    urgent = spark.range(1).select(source_id(F.lit("1-URGENT")).alias("source_id"))
    return _hex(fold.scoped_consensus(world.evidence(spark, sf_dir), urgent).select("id", "rating", "rd", "volatility", "witness_count"))


@query()
def evict_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.ids import source_id
    from ..operators.model import cut

    e = cut(world.evidence(spark, sf_dir), "evidence")
    gone = spark.range(1).select(source_id(F.lit("5-LOW")).alias("source_id"))
    _, left = fold.evict(e, cut(fold.fold(e), "consensus"), gone)
    return _hex(left.select("id", "rating", "rd", "witness_count"))


@query(sql(f"SELECT subject_id, type_id, object_id, CAST(least(floor(rd / 0.95), 350000000000) AS BIGINT) AS rd FROM consensus WHERE relation = 'SUPPLIES'"))
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fold.decay(world.counted(spark, sf_dir), F.lit(True))
    return _hex(c.filter(F.col("type_id") == F.lit(type_id("SUPPLIES"))).select("subject_id", "type_id", "object_id", "rd"))


@query(sql(f"SELECT count(*) AS affected_rows FROM consensus WHERE {_EFF} < 1000000000000"))
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.prune(world.counted(spark, sf_dir), 1_000_000_000_000)


@query(sql(f"SELECT subject_id, min(object_id) AS first_object, round(max({_EFF} / 1e9), 3) AS best, bool_or(rating + 2 * rd < 1500000000000) AS any_refuted FROM consensus WHERE subject_id IN (SELECT subject_id FROM consensus WHERE object_id IN (md5('region:0'), md5('nation:0')) AND relation IN ('IN_REGION', 'IN_NATION')) GROUP BY subject_id"))
def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    inside = c.filter(F.col("object_id").isin(entity("region:0"), entity("nation:0"))).select("subject_id").distinct()
    return _hex(c.join(inside, "subject_id", "left_semi").groupBy("subject_id").agg(F.min("object_id").alias("first_object"), F.max(eff_mu_display()).alias("best"), F.bool_or(refuted()).alias("any_refuted")))


@query(sql(f"SELECT relation, count(*) AS cells, CAST(sum(witness_count) AS BIGINT) AS witnesses, round(avg(({_EFF} - 1500000000000) / 1e9 / (400.0 / ln(10.0))), 6) AS mean_logit FROM consensus GROUP BY relation"))
def relation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("cells"), F.sum("witness_count").alias("witnesses"), F.round(F.avg(belief_logit()), 6).alias("mean_logit"))


@query("""WITH d AS (SELECT l_suppkey, count(*) AS g, CAST(sum(CAST(round(l_quantity / 50 * 1e9) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST(CASE WHEN 2 * s > g * 1000000000 THEN 2 WHEN 2 * s < g * 1000000000 THEN 0 ELSE 1 END AS SMALLINT) AS outcome FROM d""")
def supplier_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = world.table(spark, sf_dir, "lineitem")
    d = lines.groupBy("l_suppkey").agg(F.count("*").alias("g"), F.sum(F.round(F.col("l_quantity") / 50 * 1e9).cast("long")).alias("s"))
    return d.select("l_suppkey", outcome("g", "s").alias("outcome"))
