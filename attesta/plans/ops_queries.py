"""Queries on counts, runs, sources, identities and prompts over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rating import eff_mu
from ..operators import census, converse, edges, inspect, lexical, ops, realize, recall
from . import lexicon, world
from .census_queries import _orders
from .edge_queries import _EFF, _NOT_REFUTED, _hex
from .lexicon import _labels, _rated, _t, consensus, names, parts, words
from .registry import query
from .world import rated, sql, table, type_id

_KINDS = [("region", "region", "r_regionkey", 4), ("nation", "nation", "n_nationkey", 3), ("customer", "customer", "c_custkey", 2), ("supplier", "supplier", "s_suppkey", 2), ("part", "part", "p_partkey", 1), ("order", "orders", "o_orderkey", 0)]
_SRC = "md5('substrate/source/' || {} || '/v1')"
_ENTITIES = "entities AS (" + " UNION ALL ".join(f"SELECT md5('{k}:' || {key}) AS id, '{k}:' || {key} AS name, md5('{k}') AS type_id, {tier}::SMALLINT AS tier, {_SRC.format('o_orderpriority' if k == 'order' else chr(39) + 'register' + chr(39))} AS first_observed_by FROM {t}" for k, t, key, tier in _KINDS) + ")"
_EV = "ev AS (SELECT md5('customer:' || o_custkey) AS subject_id, md5('part:' || l_partkey) AS object_id, md5('substrate/source/' || o_orderpriority || '/v1') AS source_id, md5('order:' || o_orderkey) AS context_id, count(*) AS observations, CAST(sum(CAST(round((1 - 5 * l_discount) * 1e9) AS BIGINT)) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, name, key, tier in _KINDS:
        source = F.col("o_orderpriority") if kind == "order" else F.lit("register")
        rows = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("name"), source.alias("source"))
        one = rows.select(ids.canonical_id("name").alias("id"), "name", F.lit(bytearray(world.entity(kind))).alias("type_id"), F.lit(tier).cast("short").alias("tier"), ids.source_id("source").alias("first_observed_by"))
        out = one if out is None else out.unionByName(one)
    return out


def _source(name: str) -> bytes:
    return world.entity(f"substrate/source/{name}/v1")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS source, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"


@query(f"WITH {_ENTITIES} SELECT type_id, tier, count(*) AS entities FROM entities GROUP BY ALL")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(ops.type_counts(entities(spark, sf_dir)))


@query(f"WITH {_ENTITIES} SELECT count(*) AS n FROM entities WHERE type_id = md5('part')")
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count(entities(spark, sf_dir), type_id=world.entity("part"))


@query(sql("SELECT count(*) AS n FROM consensus WHERE relation = 'SUPPLIES'"))
def consensus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count(world.counted(spark, sf_dir), type_id=type_id("SUPPLIES"))


@query(sql(f"{_ENTITIES} SELECT tier, count(*) AS relations FROM consensus LEFT JOIN entities ON id = subject_id GROUP BY tier"))
def consensus_tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tiers_of_subjects(world.counted(spark, sf_dir), entities(spark, sf_dir))


@query(f"WITH {_ENTITIES} SELECT count(*) AS n FROM entities WHERE id IN (SELECT md5('part:' || l_partkey) FROM lineitem) AND first_observed_by = md5('substrate/source/register/v1')")
def content_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "lineitem").select(ids.canonical_id(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("entity_id"))
    return ops.content_count(entities(spark, sf_dir), placed, _source("register"))


@query(f"WITH {_ENTITIES} SELECT tier, count(*) AS entities FROM entities WHERE first_observed_by = md5('substrate/source/register/v1') GROUP BY tier")
def source_tier_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.source_tiers(entities(spark, sf_dir), _source("register"))


@query(f"WITH {_ENTITIES}, {_EV} SELECT id AS entity_id, name, CAST(sum(observations) AS BIGINT) AS observations FROM entities JOIN ev ON subject_id = id WHERE tier = 2 AND source_id = md5('substrate/source/5-LOW/v1') GROUP BY ALL ORDER BY observations DESC, entity_id LIMIT 20")
def surface_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(ops.surface_sample(entities(spark, sf_dir), _orders(spark, sf_dir), _source("5-LOW"), 2))


@query(sql(f"{_ENTITIES}, {_EV} SELECT 'entities' AS metric, (SELECT count(*) FROM entities) AS value UNION ALL SELECT 'attestations', (SELECT count(*) FROM ev) UNION ALL SELECT 'consensus', (SELECT count(*) FROM consensus) UNION ALL SELECT 'physicalities', (SELECT count(*) FROM embeddings)"))
def substrate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_counts({"entities": entities(spark, sf_dir), "attestations": _orders(spark, sf_dir), "consensus": world.counted(spark, sf_dir), "physicalities": table(spark, sf_dir, "embeddings")})


@query(f"WITH {_ENTITIES}, t AS (SELECT max(ts) AS now FROM events) SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM embeddings) AS physicalities, max(ts) AS last_flush_at, count(*) FILTER (ts > now - INTERVAL 3600 SECONDS) AS flushes_in_window FROM events, t")
def substrate_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    flushes = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"))
    now = F.lit(flushes.agg(F.max("at")).first()[0])
    return ops.pulse({"entities": entities(spark, sf_dir), "physicalities": table(spark, sf_dir, "embeddings")}, flushes, now, "3600 seconds")


@query(f"WITH {_ENTITIES} SELECT count(*) FILTER (name ILIKE 'part:%') AS parts, count(*) FILTER (name ILIKE 'ORDER:%') AS orders, count(*) FILTER (name ILIKE '%:1%') AS ones FROM entities")
def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.modality_counts(entities(spark, sf_dir), {"parts": "part:%", "orders": "ORDER:%", "ones": "%:1%"})


@query(f"WITH {_RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 20")
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.runs(runs(spark, sf_dir))


@query("SELECT l_orderkey AS run_id, l_linenumber AS path, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE 'pending' END AS status FROM lineitem WHERE l_orderkey = 1 ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 3 ELSE 2 END, path LIMIT 200")
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("pending")
    return ops.files(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("path"), status.alias("status")), 1)


@query(f"WITH {_RUNS} SELECT run_id, source, started_at, CASE WHEN source = '5-LOW' AND status = 'running' THEN 'cancelled' ELSE status END AS status FROM runs")
def ingest_run_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.close_runs(runs(spark, sf_dir), F.col("source") == "5-LOW")


@query("SELECT l_orderkey AS run_id, count(DISTINCT l_partkey) AS entities, count(*) AS physicalities, count(*) - count(DISTINCT l_partkey) AS orphaned FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_partkey)")
def ingest_integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.countDistinct("l_partkey").alias("entities"), F.count("*").alias("physicalities"))
    return ops.integrity_gate(counted)


@query(f"WITH {_RUNS}, {_EV}, j AS (SELECT md5('substrate/source/' || source || '/v1') AS source_id, arg_max(status, (started_at, run_id)) AS last_status, max(started_at) AS last_run_at FROM runs GROUP BY 1), e AS (SELECT source_id, count(*) AS evidence FROM ev GROUP BY 1) SELECT source_id, n.source, coalesce(last_status = 'done', FALSE) OR coalesce(evidence, 0) > 0 AS ingested, n.source IS NOT NULL AS known, coalesce(evidence, 0) AS evidence, last_status, last_run_at FROM j FULL JOIN e USING (source_id) LEFT JOIN (SELECT DISTINCT md5('substrate/source/' || o_orderpriority || '/v1') AS source_id, o_orderpriority AS source FROM orders WHERE o_orderpriority <> '5-LOW') n USING (source_id)")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = runs(spark, sf_dir).withColumn("source_id", ids.source_id("source"))
    known = journal.filter("source <> '5-LOW'").select("source_id", "source").distinct()
    return _hex(ops.source_status(journal, _orders(spark, sf_dir), known))


@query(f"WITH {_EV} SELECT count(*) > 0 AS present FROM ev WHERE source_id = md5('substrate/source/2-HIGH/v1')")
def source_bootstrap_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bootstrap_present(_orders(spark, sf_dir), _source("2-HIGH"), type_id("ORDERED"))


@query(sql("SELECT type_id, count(*) AS n FROM consensus GROUP BY type_id"))
def type_sizes_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world.counted(spark, sf_dir)
    return _hex(census.counts_by_types(c.select("type_id"), world.law(spark).select("type_id")).withColumnRenamed("entities", "n"))


# --- identity -----------------------------------------------------------------------------------------------------


@query(f"WITH {_ENTITIES} SELECT count(*) AS tier0_count, CAST(1114112 AS BIGINT) AS atom_window, CAST(0 AS BIGINT) AS over_window, count(*) FILTER (id NOT IN (SELECT md5('order:' || l_orderkey) FROM lineitem)) AS unresolvable_ids FROM entities WHERE tier = 0")
def atom_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = table(spark, sf_dir, "lineitem").select(ids.canonical_id(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))).alias("id"))
    return ops.atom_census(entities(spark, sf_dir), atoms)


@query(f"WITH {_ENTITIES} SELECT tier, count(*) AS n FROM entities WHERE type_id IN (md5('customer'), md5('nation')) GROUP BY tier")
def compositional_tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.composed_tiers(entities(spark, sf_dir), [world.entity("customer"), world.entity("nation")])


@query(f"WITH {_ENTITIES}, v AS (SELECT DISTINCT type_id AS id, NULL::SMALLINT AS tier, 'dangling_entity_type' AS reason FROM entities UNION ALL SELECT md5('nation:' || n_regionkey), NULL, 'ambiguous_physicality' FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_nationkey) > 1) SELECT id, tier, reason FROM v")
def identity_law_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' curves by region stand for places: a region's number has several, so its key is ambiguous."""
    n = table(spark, sf_dir, "nation").select(ids.canonical_id(F.concat(F.lit("nation:"), F.col("n_regionkey").cast("string"))).alias("entity_id"), F.lit(1).alias("phys_type"), F.col("n_regionkey").alias("id"), F.array("n_nationkey").alias("points"))
    return _hex(census.identity_violations(entities(spark, sf_dir), n))


@query(f"WITH {_ENTITIES} SELECT FALSE AS ok, CAST(0 AS BIGINT) AS fake_tier_bands, count(DISTINCT type_id) AS identity_violations, count(*) FILTER (first_observed_by = md5('substrate/source/register/v1')) AS bootstrap_entities, TRUE AS deep_checked FROM entities")
def substrate_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    none = spark.createDataFrame([], "entity_id binary, phys_type int, id long, points array<long>")
    return ops.health(e, census.identity_violations(e, none), _source("register")).select("ok", "fake_tier_bands", "identity_violations", "bootstrap_entities", "deep_checked")


# --- readable edges -----------------------------------------------------------------------------------------------


@query(lexicon._sql("SELECT s.name AS subject, lower(replace(relation, '_', ' ')) AS type, o.name AS object, round((rating - 2 * rd) / 1e9, 3) AS eff_mu, witness_count AS witnesses FROM (SELECT * FROM consensus WHERE rating + 2 * rd >= 1500000000000 ORDER BY rank * (rating - 2 * rd) / 1e9 DESC, subject_id, type_id, object_id LIMIT 10) JOIN names s ON s.id = subject_id JOIN names o ON o.id = object_id"))
def top_relations_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.readable(edges.top_relations(_rated(spark, sf_dir), 10), _labels(spark, sf_dir))


@query(lexicon._sql("r AS (SELECT l.*, row_number() OVER (PARTITION BY subject_id ORDER BY round(rank * mu / 1e9, 9) DESC, object_id, md5(relation)) AS place FROM links l WHERE subject_id IN (SELECT word FROM words)) SELECT s.name AS subject, lower(replace(relation, '_', ' ')) AS type, o.name AS object, eff_mu, witnesses FROM r JOIN names s ON s.id = subject_id JOIN names o ON o.id = object_id WHERE place <= 6"))
def consensus_out_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = words(spark, sf_dir).select(F.col("word").alias("subject_id"))
    return inspect.readable(inspect.out_edges(_rated(spark, sf_dir), subjects, 6), _labels(spark, sf_dir))


@query(f"WITH {_ENTITIES} SELECT id, tier, type_id FROM entities WHERE tier >= 3")
def entity_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return _hex(inspect.facets(e, e.filter("tier >= 3").select("id")))


@query("SELECT vec_id AS entity_id, round(embedding[1]::DOUBLE, 9) AS x, round(embedding[2]::DOUBLE, 9) AS y, round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2), 9) AS radius FROM embeddings")
def entity_physicalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.lit(1).cast("short").alias("phys_type"), F.struct(*[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyzm")]).alias("coord"), F.array().alias("points"))
    rows = inspect.physicalities(v, v.select("entity_id"))
    return rows.select("entity_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("radius", 9).alias("radius"))


# --- words of prompts ---------------------------------------------------------------------------------------------

_PROMPTS = """prompts AS (SELECT p_partkey AS prompt_id, 'The ' || p_name || ', please' AS text FROM part),
tok AS (SELECT prompt_id, unnest(['the', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), ',', 'please']) AS word, unnest(range(5)) AS ord FROM prompts JOIN part ON p_partkey = prompt_id),
res AS (SELECT prompt_id, ord, t.word, w.word AS entity_id FROM tok t LEFT JOIN words w ON w.text = t.word)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = parts(spark, sf_dir).select(F.col("p_partkey").alias("prompt_id"), F.concat(F.lit("The "), "p_name", F.lit(", please")).alias("text"))
    return converse.word_segment(prompts).drop("id")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(F.col("text").alias("name"), F.col("word").alias("id"))


def _tongues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(F.col("word").alias("id"), F.substring("text", 1, 1).alias("lang"), F.lit(1.0).alias("mu"))


@query(lexicon._sql(f"{_PROMPTS} SELECT prompt_id, CAST(ord AS INTEGER) AS ord, r.word, entity_id, substr(w.text, 1, 1) AS language FROM res r LEFT JOIN words w ON w.word = entity_id"))
def prompt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(converse.prompt_state(_tokens(spark, sf_dir), _known(spark, sf_dir), _tongues(spark, sf_dir)))


@query(lexicon._sql(f"{_PROMPTS}, m AS (SELECT word, count(DISTINCT sense_id) AS senses FROM senses GROUP BY 1) SELECT prompt_id, CAST(ord AS INTEGER) AS ord, r.word, entity_id IS NOT NULL AS resolved, coalesce(senses, 0) AS senses, substr(w.text, 1, 1) AS language, CASE WHEN entity_id IS NULL THEN 'unknown' WHEN coalesce(senses, 0) = 0 THEN 'no sense' WHEN senses > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM res r LEFT JOIN words w ON w.word = entity_id LEFT JOIN m ON m.word = entity_id"))
def resolve_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.senses(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"))
    tiers = words(spark, sf_dir).select(F.col("word").alias("id"), F.lit(2).cast("short").alias("tier"))
    return converse.resolve_audit(_tokens(spark, sf_dir), _known(spark, sf_dir), tiers, found, _tongues(spark, sf_dir)).drop("tier")


@query(lexicon._sql(f"{_PROMPTS} SELECT prompt_id, arg_max(entity_id, ord) AS id FROM res WHERE entity_id IS NOT NULL GROUP BY 1"))
def resolve_last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(converse.resolve_last_word(_tokens(spark, sf_dir), _known(spark, sf_dir)))


@query(lexicon._sql(f"{_PROMPTS} SELECT prompt_id, arg_min(entity_id, ord) AS id FROM res WHERE entity_id IN (SELECT object_id FROM consensus WHERE relation = 'CAUSES') GROUP BY 1"))
def first_placed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = consensus(spark, sf_dir).filter(F.col("type_id") == F.lit(type_id("CAUSES"))).select(F.col("object_id").alias("id"))
    return _hex(converse.first_placed_topic(_tokens(spark, sf_dir), _known(spark, sf_dir), placed))


@query("SELECT p_partkey AS prompt_id, CAST(1 AS INTEGER) AS ord, CAST(2 AS INTEGER) AS length, md5('name:' || p_name) AS id FROM part")
def resolve_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = parts(spark, sf_dir).select(F.col("p_name").alias("name")).distinct().withColumn("id", ids.canonical_id(F.concat(F.lit("name:"), "name")))
    return _hex(converse.resolve_phrase(_tokens(spark, sf_dir), whole.unionByName(_known(spark, sf_dir))).withColumn("ord", F.col("ord").cast("int")))


@query("SELECT ref, CASE WHEN length(ref) = 32 THEN ref WHEN ref LIKE '%zz' THEN NULL ELSE md5('word:' || ref) END AS id FROM (SELECT DISTINCT unnest([w, md5(w), w || 'zz']) AS ref FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))")
def resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    refs = w.select(F.explode(F.array("text", F.md5("text"), F.concat("text", F.lit("zz")))).alias("ref")).distinct()
    return _hex(converse.resolve_ref(refs, _known(spark, sf_dir)))


@query(lexicon._sql("SELECT word, md5('lang:' || substr(text, 1, 1)) AS language_id FROM words WHERE word IN (SELECT subject_id FROM links WHERE relation = 'HAS_LANGUAGE')"))
def word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(converse.word_language(consensus(spark, sf_dir), type_id("HAS_LANGUAGE")))


@query(f"WITH {_EV}, m AS (SELECT subject_id AS id, context_id, sum(s) AS mass FROM ev GROUP BY ALL) SELECT id, arg_min(context_id, (-mass, context_id)) AS lang FROM m GROUP BY id")
def attested_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    return _hex(converse.attested_language(e, e.select(F.col("subject_id").alias("id"))))


@query(lexicon._sql("""ways AS (SELECT subject_id AS word, object_id AS target, relation, TRUE AS outbound, mu, rank FROM links UNION ALL SELECT object_id, subject_id, relation, FALSE, mu, rank FROM links WHERE subject_id <> object_id),
r AS (SELECT *, round(rank * mu / 1e9, 6) AS strength FROM ways WHERE word IN (SELECT word FROM words)), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY strength DESC, target, relation, outbound DESC) AS INTEGER) AS place FROM r)
SELECT word, place, relation, target, outbound, strength FROM n WHERE place <= 10"""))
def converse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(converse.links(_rated(spark, sf_dir), words(spark, sf_dir), 10).withColumn("place", F.col("place").cast("int")))


@query(lexicon._sql(f"{_PROMPTS}, k AS (SELECT DISTINCT word, entity_id FROM res), d AS (SELECT object_id, count(*) AS n FROM consensus GROUP BY 1), o AS (SELECT subject_id, count(*) AS out_edges, CAST(sum(witnesses) AS BIGINT) AS witnesses FROM links GROUP BY 1) SELECT k.word, entity_id, coalesce(n, 0) AS containers, round(1 / log2(2 + coalesce(n, 0)), 9) AS icf, coalesce(out_edges, 0) AS out_edges, coalesce(witnesses, 0) AS witnesses FROM k LEFT JOIN d ON object_id = entity_id LEFT JOIN o ON subject_id = entity_id"))
def election_token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rated(spark, sf_dir)
    degree = c.groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("degree"))
    rows = converse.election_profile(_tokens(spark, sf_dir), _known(spark, sf_dir), degree, c)
    return _hex(rows.select("word", "entity_id", "containers", F.round("icf", 9).alias("icf"), "out_edges", "witnesses"))


@query("SELECT shape, needs_topic2 FROM (VALUES " + ", ".join(f"('{s[0]}', {str(s[2]).upper()})" for s in converse.SHAPES) + ") t(shape, needs_topic2)")
def query_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converse.query_shapes(spark).select("shape", "needs_topic2")


@query(lexicon._sql("SELECT id, name AS label, regexp_matches(name, '\\p{L}') AS content FROM names"))
def label_is_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).withColumnRenamed("name", "label")
    return _hex(rows.withColumn("content", converse.label_is_content()))


@query(lexicon._sql("""r AS (SELECT subject_id AS topic, CASE relation WHEN 'HAS_DEFINITION' THEN 1 WHEN 'IS_A' THEN 2 WHEN 'IS_SYNONYM_OF' THEN 3 WHEN 'HAS_SENSE' THEN 3 ELSE 99 END AS tier, relation, object_id, rank, mu FROM links WHERE subject_id IN (SELECT word FROM words)),
n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY tier, round(rank * mu / 1e9, 9) DESC, object_id, md5(relation)) AS place FROM r)
SELECT topic, string_agg(t.name || ' ' || lower(replace(relation, '_', ' ')) || ' ' || o.name || '.', ' ' ORDER BY place) AS text FROM n JOIN names t ON t.id = topic JOIN names o ON o.id = object_id WHERE place <= 6 GROUP BY topic"""))
def converse_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = recall.facts(_rated(spark, sf_dir), lexicon._topics(spark, sf_dir), {"definitional": 1, "taxonomic": 2, "equivalence": 3}, 12)
    return _hex(converse.about(facts, _labels(spark, sf_dir)))


@query("SELECT p_partkey AS id, CAST((p_partkey * 2147483648 + 6) >> 31 & 2097151 AS INTEGER) AS atom, CAST(((p_partkey * 2147483648 + 6) >> 1) & 31 AS SMALLINT) AS tier FROM part")
def vertex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * F.lit(1 << 31) + 6).alias("flags"))
    return rows.select("id", realize.vertex_atom().alias("atom"), realize.vertex_tier().alias("tier"))


@query(sql(f"p AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {_EFF} DESC, object_id, type_id) AS place FROM consensus) SELECT subject_id, type_id, object_id, CASE WHEN NOT ({_NOT_REFUTED}) THEN 'refuted' WHEN {_EFF} > 1500000000000 THEN 'confirmed' ELSE 'thin' END AS status FROM p WHERE place <= 30"))
def epistemic_status_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(eff_mu().desc(), "object_id", "type_id"))
    rows = edges.epistemic_status(rated(spark, sf_dir)).withColumn("place", place).filter("place <= 30")
    return _hex(rows.select("subject_id", "type_id", "object_id", F.col("verdict").alias("status")))


@query("SELECT md5('substrate/source/' || n || '/v1') AS id, n AS name FROM (SELECT p_brand AS n FROM part UNION SELECT p_type FROM part)")
def register_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    have = p.select(F.col("p_brand").alias("name")).distinct().withColumn("id", ids.canonical_id("name")).select("id", "name")
    out = realize.register_canonicals(have, p.select(F.col("p_type").alias("name")).union(p.select("p_brand")))
    return out.select(F.lower(F.hex(ids.source_id("name"))).alias("id"), "name")
