"""Reads behind a conversation: tokens and their ids, topics, contrasts, predictions, catalogues, rendered paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_id
from ..functions.rating import eff_mu, refuted
from . import graph, model


def word_segment(prompts: DataFrame) -> DataFrame:
    """prompts (prompt_id, text) to their tokens: words, numbers and single marks, with the ids of their lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}]+)?|[^\s\p{L}\p{N}])"), 1)
    rows = prompts.select("prompt_id", F.posexplode(found).alias("ord", "word"))
    return rows.withColumn("id", canonical_id("word"))


def resolve(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """tokens with the entity that each word names (names: name, id), null if none does."""
    known = names.groupBy(F.lower("name").alias("word")).agg(F.min("id").alias("entity_id"))
    return tokens.join(known, "word", "left")


def resolve_topic(tokens: DataFrame, names: DataFrame, degree: DataFrame) -> DataFrame:
    """Each prompt's topic: the resolved token that the fewest things hold (degree: id, degree), the first of them."""
    rows = resolve(tokens, names).filter("entity_id is not null").join(degree.select(F.col("id").alias("entity_id"), "degree"), "entity_id", "left")
    best = F.min_by(F.struct("entity_id", "word"), F.struct(F.coalesce("degree", F.lit(0)).alias("d"), "ord"))
    return rows.groupBy("prompt_id").agg(best.alias("x")).select("prompt_id", "x.entity_id", "x.word")


def prompt_language(tokens: DataFrame, languages: DataFrame) -> DataFrame:
    """The mass of each language over a prompt's distinct ids (languages: id, lang, mu), the largest first."""
    mass = tokens.select("prompt_id", "id").distinct().join(languages, "id").groupBy("prompt_id", "lang").agg(F.sum("mu").alias("mass"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("mass"), "lang"))
    return mass.withColumn("place", place)


def contrast(edges: DataFrame, pairs: DataFrame, up: list[bytes], features: list[bytes], depth: int = 4, limit: int = 80) -> DataFrame:
    """For each pair (x, y): what is above or said of x only, of y only, and of both, the best first."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    above = graph.ancestry(edges, ids, up, depth).select(F.col("start").alias("id"), F.col("ancestor_id").alias("fact"), F.lit(None).cast("binary").alias("type_id"), F.col("best_eff_mu").alias("mu"))
    own = edges.filter(F.col("type_id").isin(*features) & ~refuted()).join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
    said = own.select(F.col("subject_id").alias("id"), F.col("object_id").alias("fact"), "type_id", eff_mu().alias("mu"))
    facts = above.unionByName(said).groupBy("id", "type_id", "fact").agg(F.max("mu").alias("mu"))
    x = pairs.join(facts.withColumnRenamed("id", "x"), "x").withColumn("holder", F.lit("x"))
    y = pairs.join(facts.withColumnRenamed("id", "y"), "y").withColumn("holder", F.lit("y"))
    both = x.unionByName(y).groupBy("x", "y", "type_id", "fact").agg(F.when(F.countDistinct("holder") > 1, "both").otherwise(F.max("holder")).alias("holder"), F.max("mu").alias("mu"))
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("mu"), "fact", "type_id"))
    return both.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def correlate(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(relation, target) that the given words (id) reach: how many of them, which, and the best rating."""
    own = edges.filter(~refuted()).join(words.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_semi")
    return own.groupBy("relation", "object_id").agg(F.countDistinct("subject_id").alias("words"), F.array_sort(F.collect_set("subject_id")).alias("which"), (F.max(eff_mu()) / F.lit(1e9)).alias("strength"))


def infer(edges: DataFrame, topics: DataFrame, context: DataFrame, limit: int = 8) -> DataFrame:
    """For each prompt's topic (prompt_id, id) its objects, those with most edges into the context (prompt_id, id) first."""
    own = edges.filter(~refuted()).join(topics.select("prompt_id", F.col("id").alias("subject_id")), "subject_id")
    found = own.groupBy("prompt_id", "object_id").agg(F.max(eff_mu()).alias("mu"))
    # edges into the context meet what was found, not all prompts of that context
    wanted = context.select("prompt_id", "id").distinct()
    into = edges.select(F.col("subject_id").alias("object_id"), F.col("object_id").alias("id")).join(wanted.select("id").distinct(), "id", "left_semi")
    near = into.groupBy("object_id").agg(F.collect_set("id").alias("into"))
    asked = wanted.groupBy("prompt_id").agg(F.collect_list("id").alias("context"))
    rows = found.join(near, "object_id", "left").join(asked, "prompt_id", "left")
    hits = F.coalesce(F.size(F.array_intersect("into", "context")), F.lit(0)).cast("long")
    rows = rows.select("prompt_id", "object_id", "mu", F.when(F.col("into").isNotNull() & F.col("context").isNotNull(), hits).otherwise(F.lit(0).cast("long")).alias("bias_hits"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("bias_hits"), F.desc("mu"), "object_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def hypernyms(edges: DataFrame, words: DataFrame, types: list[bytes], depth: int = 8) -> DataFrame:
    """The chain upward from each word by its best edge of the given types."""
    return graph.walk_strongest(edges, words, depth, types)


def relation_bands(edges: DataFrame, law: DataFrame) -> DataFrame:
    """Every band with its rank, its relations and how many edges they have."""
    own = edges.groupBy("band").agg(F.count("*").alias("consensus_rows"))
    kinds = law.groupBy("band").agg(F.count("*").alias("relation_types"))
    catalogue = law.sparkSession.createDataFrame([(i + 1, b, r) for i, (b, r) in enumerate(model.BAND_RANKS.items())], "number int, band string, rank double")
    return catalogue.join(kinds, "band", "left").join(own, "band", "left").fillna(0, ["relation_types", "consensus_rows"])


def rendered_path(paths: DataFrame, labels: DataFrame, law: DataFrame) -> DataFrame:
    """paths (source, target, nodes, types) as text: a —relation→ b."""
    nodes = paths.select("source", "target", F.posexplode("nodes").alias("at", "id")).join(labels.select("id", "label"), "id", "left")
    steps = paths.select("source", "target", F.posexplode("types").alias("at", "type_id")).join(F.broadcast(law.select("type_id", "relation")), "type_id", "left")
    parts = nodes.join(steps.select("source", "target", "at", "relation"), ["source", "target", "at"], "left")
    text = F.concat(F.coalesce("label", F.lower(F.hex("id"))), F.when(F.col("relation").isNotNull(), F.concat(F.lit(" —"), "relation", F.lit("→ "))).otherwise(""))
    listed = F.sort_array(F.collect_list(F.struct("at", text.alias("t"))))
    return parts.groupBy("source", "target").agg(F.concat_ws("", F.transform(listed, lambda s: s["t"])).alias("chain"))


def session_trajectory(turns: DataFrame, k: int = 8) -> DataFrame:
    """The topics of each session (session_id, ord, topic_id), the most recent first."""
    rows = turns.filter("topic_id is not null").groupBy("session_id", "topic_id").agg(F.max("ord").alias("last_ord"), F.count("*").alias("mentions"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last_ord"), "topic_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


# --- resolving prompts --------------------------------------------------------------------------------------------

#: The shapes of reads that a prompt can ask for: name, what it gives, whether it needs a second topic, a relation, takes a language.
SHAPES = [
    ("define", "definitions of the topic", False, False, False),
    ("describe", "its most salient facts", False, False, False),
    ("examples", "examples of its use", False, False, False),
    ("interaction", "what it leads to", False, False, False),
    ("is_a", "whether it is a kind of the second topic", True, False, False),
    ("languages", "languages with a word for it", False, False, False),
    ("related", "what it has under a relation", False, True, False),
    ("related_in", "what has it under a relation", False, True, False),
    ("relation", "how two topics are related", True, False, False),
    ("synonyms", "words of the same meaning", False, False, False),
    ("translate", "words of other languages", False, False, True),
    ("walk", "its strongest chain", False, False, False),
    ("complete", "its best continuation", False, False, False),
    ("what_is", "definitions and what is above it", False, False, False),
]


def query_shapes(spark) -> DataFrame:
    return spark.createDataFrame(SHAPES, "shape string, summary string, needs_topic2 boolean, needs_type boolean, accepts_lang boolean")


def label_is_content(label: str = "label"):
    """Whether a label says something: it has a letter and isn't an id's digits."""
    return F.coalesce(F.col(label).rlike(r"\p{L}") & ~F.col(label).rlike("^[0-9a-f]{16,}…?$") & ~F.col(label).startswith("substrate/"), F.lit(False))


def resolve_ref(refs: DataFrame, names: DataFrame) -> DataFrame:
    """ref, id: 32 hexadecimal digits are the id itself, anything else is looked up as a name (names: name, id)."""
    known = names.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("_id"))
    hexed = F.col("ref").rlike("^[0-9a-fA-F]{32}$")
    return refs.join(known, F.lower("ref") == F.col("_key"), "left").select("ref", F.when(hexed, F.unhex("ref")).otherwise(F.col("_id")).alias("id"))


def resolve_last_word(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """prompt_id, id: the last token that names something."""
    return resolve(tokens, names).filter("entity_id is not null").groupBy("prompt_id").agg(F.max_by("entity_id", "ord").alias("id"))


def first_placed_topic(tokens: DataFrame, names: DataFrame, placed: DataFrame) -> DataFrame:
    """prompt_id, id: the first token whose entity has a place (placed: id)."""
    rows = resolve(tokens, names).join(placed.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return rows.groupBy("prompt_id").agg(F.min_by("entity_id", "ord").alias("id"))


def resolve_phrase(tokens: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """prompt_id, ord, length, id: the longest run of tokens that is a known name, the first of them if equal."""
    w = Window.partitionBy("prompt_id").orderBy("ord")
    runs = tokens.select("prompt_id", "ord", F.collect_list("word").over(w.rowsBetween(0, longest - 1)).alias("near"))
    each = runs.select("prompt_id", "ord", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("near")), lambda k: F.array_join(F.slice("near", 1, k), " "))).alias("length", "phrase"))
    known = names.groupBy(F.lower("name").alias("phrase")).agg(F.min("id").alias("id"))
    best = each.join(known, "phrase").groupBy("prompt_id").agg(F.min(F.struct((-F.col("length")).alias("k"), "ord", "id")).alias("x"))
    return best.select("prompt_id", "x.ord", (1 - F.col("x.k")).alias("length"), "x.id")


def prompt_state(tokens: DataFrame, names: DataFrame, languages: DataFrame) -> DataFrame:
    """tokens with the entity that each names and its best language (languages: id, lang, mu)."""
    best = languages.groupBy(F.col("id").alias("entity_id")).agg(F.min_by("lang", F.struct(-F.col("mu"), "lang")).alias("language"))
    return resolve(tokens, names).join(best, "entity_id", "left").select("prompt_id", "ord", "word", "entity_id", "language")


def resolve_audit(tokens: DataFrame, names: DataFrame, tiers: DataFrame, senses: DataFrame, languages: DataFrame) -> DataFrame:
    """prompt_id, ord, word, resolved, tier, senses, language, verdict of each token. tiers: (id, tier); senses: (word, sense_id)."""
    many = senses.groupBy(F.col("word").alias("entity_id")).agg(F.countDistinct("sense_id").alias("senses"))
    rows = prompt_state(tokens, names, languages).join(tiers.groupBy(F.col("id").alias("entity_id")).agg(F.min("tier").alias("tier")), "entity_id", "left").join(many, "entity_id", "left")
    n = F.coalesce("senses", F.lit(0).cast("long"))
    verdict = F.when(F.col("entity_id").isNull(), "unknown").when(n == 0, "no sense").when(n > 1, "ambiguous").otherwise("ok")
    return rows.select("prompt_id", "ord", "word", F.col("entity_id").isNotNull().alias("resolved"), "tier", n.alias("senses"), "language", verdict.alias("verdict"))


def word_language(consensus: DataFrame, language: bytes) -> DataFrame:
    """word, language_id: the strongest language of each word."""
    rows = consensus.filter((F.col("type_id") == F.lit(language)) & ~refuted())
    return rows.groupBy(F.col("subject_id").alias("word")).agg(F.min_by("object_id", F.struct(-eff_mu(), "object_id")).alias("language_id"))


def attested_language(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """id, lang: the context in which each id's (id) evidence has the largest sum of scores."""
    own = evidence.filter("context_id is not null").join(ids.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_semi")
    mass = own.groupBy("subject_id", "context_id").agg(F.sum("sum_score_fp").alias("mass"))
    return mass.groupBy(F.col("subject_id").alias("id")).agg(F.min_by("context_id", F.struct(-F.col("mass"), "context_id")).alias("lang"))


def links(edges: DataFrame, words: DataFrame, limit: int = 40) -> DataFrame:
    """word, place, relation, target, outbound, strength: all edges of each word (word), either way, the strongest first."""
    own = edges.filter(~refuted() & F.col("object_id").isNotNull())
    ways = own.select(F.col("subject_id").alias("word"), F.col("object_id").alias("target"), "relation", F.lit(True).alias("outbound"), "rating", "rd", "rank")
    ways = ways.unionByName(own.filter("subject_id <> object_id").select(F.col("object_id").alias("word"), F.col("subject_id").alias("target"), "relation", F.lit(False).alias("outbound"), "rating", "rd", "rank"))
    rows = ways.join(words.select("word").distinct(), "word", "left_semi").withColumn("strength", F.round(F.col("rank") * eff_mu() / F.lit(1e9), 6))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("strength"), "target", "relation", F.desc("outbound")))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("word", "place", "relation", "target", "outbound", "strength")


def election_profile(tokens: DataFrame, names: DataFrame, degree: DataFrame, edges: DataFrame) -> DataFrame:
    """Each distinct token's evidence: word, entity_id, containers, icf, out_edges, witnesses, bands. degree: (id, degree)."""
    kinds = resolve(tokens.select("word").distinct(), names)
    out = edges.filter(~refuted()).groupBy(F.col("subject_id").alias("entity_id")).agg(F.count("*").alias("out_edges"), F.sum("witness_count").alias("witnesses"), F.countDistinct("band").alias("bands"))
    rows = kinds.join(degree.select(F.col("id").alias("entity_id"), F.col("degree").alias("containers")), "entity_id", "left").join(out, "entity_id", "left").fillna(0, ["containers", "out_edges", "witnesses", "bands"])
    return rows.withColumn("icf", 1 / F.log2(2 + F.col("containers")))


def operation_routes(spark, routes: list[tuple[str, str, str]]) -> DataFrame:
    """frame, shape, role of a routing table."""
    return spark.createDataFrame(routes, "frame string, shape string, role string")


def associative_types(law: DataFrame, kin: list[str], band: str = "associative") -> DataFrame:
    """Relations of a band but those of kinship."""
    return law.filter((F.col("band") == band) & ~F.col("relation").isin(*kin)).select("type_id", "relation")


def about(facts: DataFrame, labels: DataFrame, parts: int = 6) -> DataFrame:
    """topic, text: the first facts of each topic as sentences. facts: recall.facts."""
    named = facts.filter(F.col("place") <= parts).join(labels.select(F.col("id").alias("object_id"), F.col("label").alias("_object")), "object_id", "left").join(labels.select(F.col("id").alias("topic"), F.col("label").alias("_topic")), "topic", "left")
    said = F.concat("_topic", F.lit(" "), F.lower(F.translate("relation", "_", " ")), F.lit(" "), F.coalesce("_object", F.lower(F.hex("object_id"))), F.lit("."))
    listed = F.sort_array(F.collect_list(F.struct("place", said.alias("t"))))
    return named.groupBy("topic").agg(F.concat_ws(" ", F.transform(listed, lambda x: x["t"])).alias("text"))
