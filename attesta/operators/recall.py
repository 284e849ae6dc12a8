"""Answers of one line: what a conversation is told about a topic. Each takes a batch of topics and gives rows of
topic, place, reply, eff_mu and witnesses; the caller picks an intent's responder by name (respond).

labels are (id, label) of everything that may be named; an id without a label is shown by its digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import edge_rank, eff_mu, refuted, verdict
from . import edges as reads
from . import graph

#: What kinds of interaction say, in the order of the relation law; fixed values.
PHRASES = {
    "X_INTENT": "intends",
    "X_WANT": "then wants",
    "X_NEED": "first needs",
    "X_REACT": "feels",
    "X_EFFECT": "then",
    "O_WANT": "others then want",
    "O_REACT": "others feel",
    "O_EFFECT": "for others,",
    "CAUSES": "causes",
    "CAUSES_DESIRE": "causes a desire for",
    "MOTIVATED_BY_GOAL": "is motivated by",
    "HAS_PREREQUISITE": "requires",
    "HAS_SUBEVENT": "involves",
    "OBSTRUCTED_BY": "is hindered by",
}


def _named(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the label of a key; digits where there is none."""
    got = rows.join(labels.select(F.col("id").alias(key), F.col("label").alias(name)), key, "left")
    return got.withColumn(name, F.coalesce(name, F.lower(F.hex(key))))


def _shape(rows: DataFrame, reply: Column) -> DataFrame:
    return rows.select("topic", "place", reply.alias("reply"), "eff_mu", "witnesses")


def gloss(definitions: DataFrame) -> DataFrame:
    """definitions: lexical.definitions of the topics."""
    return _shape(definitions.withColumnRenamed("word", "topic"), F.col("text"))


def labelled_gloss(definitions: DataFrame, labels: DataFrame) -> DataFrame:
    rows = _named(definitions.withColumnRenamed("word", "topic"), labels, "topic", "_topic")
    return _shape(rows, F.concat("_topic", F.lit(": "), "text"))


def examples(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found: lexical.examples; %s in a text stands for the topic."""
    rows = _named(found.withColumnRenamed("word", "topic"), labels, "topic", "_topic")
    return _shape(rows, F.expr("replace(text, '%s', _topic)"))


def describe(edges: DataFrame, topics: DataFrame, labels: DataFrame, structural: list[bytes], limit: int = 24) -> DataFrame:
    """The best facts of each topic (topic): relation: object."""
    own = edges.filter(~refuted() & ~F.col("type_id").isin(*structural)).join(topics.select(F.col("topic").alias("subject_id")).distinct(), "subject_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc(F.round(edge_rank(), 9)), "object_id", "type_id"))
    best = own.withColumn("place", place).filter(F.col("place") <= limit)
    rows = _named(best.withColumn("topic", F.col("subject_id")).withColumn("eff_mu", F.round(eff_mu() / F.lit(1e9), 3)).withColumnRenamed("witness_count", "witnesses"), labels, "object_id", "_fact")
    return _shape(rows, F.concat(F.lower(F.translate("relation", "_", " ")), F.lit(": "), "_fact"))


def related(edges: DataFrame, topics: DataFrame, labels: DataFrame, type_id: bytes, incoming: bool = False, limit: int = 24) -> DataFrame:
    """What each topic has under one relation, or what has it."""
    end, other = ("object_id", "subject_id") if incoming else ("subject_id", "object_id")
    own = edges.filter(~refuted() & (F.col("type_id") == F.lit(type_id)) & F.col(other).isNotNull()).join(topics.select(F.col("topic").alias(end)).distinct(), end, "left_semi")
    place = F.row_number().over(Window.partitionBy(end).orderBy(eff_mu().desc(), other))
    best = own.withColumn("place", place).filter(F.col("place") <= limit)
    rows = best.select(F.col(end).alias("topic"), F.col(other).alias("fact"), "place", F.round(eff_mu() / F.lit(1e9), 3).alias("eff_mu"), F.col("witness_count").alias("witnesses"))
    rows = _named(_named(rows, labels, "fact", "_fact"), labels, "topic", "_topic")
    return _shape(rows, F.col("_fact") if incoming else F.expr("replace(_fact, '%s', _topic)"))


def interaction(edges: DataFrame, topics: DataFrame, labels: DataFrame, phrases: dict[str, str] = PHRASES, limit: int = 8) -> DataFrame:
    """What each topic leads to: topic — phrase object, the best edge ranks first."""
    said = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    own = edges.filter(~refuted() & F.col("relation").isin(*phrases) & F.col("object_id").isNotNull()).join(topics.select(F.col("topic").alias("subject_id")).distinct(), "subject_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc(F.round(edge_rank(), 9)), eff_mu().desc(), "object_id", "type_id"))
    best = own.withColumn("place", place).filter(F.col("place") <= limit)
    rows = best.select(F.col("subject_id").alias("topic"), "object_id", said[F.col("relation")].alias("_phrase"), "place", F.round(eff_mu() / F.lit(1e9), 3).alias("eff_mu"), F.col("witness_count").alias("witnesses"))
    rows = _named(_named(rows, labels, "object_id", "_object"), labels, "topic", "_topic")
    return _shape(rows, F.concat("_topic", F.lit(" — "), "_phrase", F.lit(" "), "_object"))


def synonyms(members: DataFrame, labels: DataFrame, limit: int = 24) -> DataFrame:
    """members: lexical.synset_members."""
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("mu"), F.desc("witnesses"), "member"))
    rows = members.withColumn("place", place).filter(F.col("place") <= limit).withColumn("eff_mu", F.round(F.col("mu") / F.lit(1e9), 3))
    return _shape(_named(rows.withColumnRenamed("word", "topic"), labels, "member", "_member"), F.col("_member"))


def translations(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found: lexical.translations (with place)."""
    rows = found.withColumnRenamed("word", "topic").withColumn("eff_mu", F.round(F.col("mu") / F.lit(1e9), 3))
    if "place" not in rows.columns:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("mu"), "language", "other")))
    return _shape(_named(rows, labels, "other", "_other"), F.concat("_other", F.lit(" ["), F.coalesce("language", F.lit("?")), F.lit("]")))


def languages(coverage: DataFrame) -> DataFrame:
    """coverage: lexical.language_coverage."""
    return coverage.select(F.col("concept").alias("topic"), F.lit(1).alias("place"), "reply", F.round(F.col("mu") / F.lit(1e9), 3).alias("eff_mu"), F.col("languages").alias("witnesses"))


def is_a(paths: DataFrame, pairs: DataFrame, chains: DataFrame, labels: DataFrame) -> DataFrame:
    """source, target, reply: Yes and the path if there is one (paths; chains: source, target, chain), else No.

    pairs: (source, target) that were asked.
    """
    asked = _named(_named(pairs.select("source", "target").distinct(), labels, "source", "_from"), labels, "target", "_to")
    found = asked.join(paths.select("source", "target", F.lit(True).alias("_found")).distinct(), ["source", "target"], "left").join(chains.select("source", "target", "chain"), ["source", "target"], "left")
    no = F.concat(F.lit('No witnessed IS_A path from "'), "_from", F.lit('" to "'), "_to", F.lit('".'))
    return found.select("source", "target", F.when(F.col("_found"), F.concat(F.lit("Yes — "), F.coalesce("chain", F.lit("")))).otherwise(no).alias("reply"))


def walk(steps: DataFrame, labels: DataFrame, law: DataFrame) -> DataFrame:
    """steps: graph.walk_strongest from the topics (start); one reply a topic, the whole chain, with its weakest rating."""
    named = _named(steps, labels, "entity_id", "_at").join(F.broadcast(law.select("type_id", "relation")), "type_id", "left")
    part = F.concat(F.lit(" —"), F.lower(F.translate(F.coalesce("relation", F.lit("?")), "_", " ")), F.lit("→ "), "_at")
    chain = named.groupBy(F.col("start").alias("topic")).agg(F.sort_array(F.collect_list(F.struct("step", part.alias("t")))).alias("parts"), F.min("eff_mu").alias("mu"))
    rows = _named(chain, labels, "topic", "_topic").withColumn("eff_mu", F.round(F.col("mu") / F.lit(1e9), 3)).withColumn("place", F.lit(1)).withColumn("witnesses", F.lit(None).cast("long"))
    return _shape(rows, F.concat("_topic", F.concat_ws("", F.transform("parts", lambda p: p["t"]))))


def complete(branches: DataFrame) -> DataFrame:
    """branches: graph.walk_branches; each start's branch of the highest mean weight, the longer one if equal."""
    mean = F.round(F.col("total") / F.greatest("depth", F.lit(1)), 9)
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc(mean), F.desc("depth"), "place"))
    return branches.withColumn("_first", place).filter("_first = 1").drop("_first")


def what_is(definitions: DataFrame, ladder: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled definitions, then what is above the topic step by step. ladder: graph.walk_strongest along is-a edges."""
    above = _named(ladder.withColumnRenamed("start", "topic"), labels, "entity_id", "_up")
    steps = above.select("topic", (F.lit(1000) + F.col("step")).alias("place"), F.concat(F.expr("repeat('  ', step)"), F.lit("→ is "), "_up").alias("reply"), F.lit(None).cast("double").alias("eff_mu"), F.lit(None).cast("long").alias("witnesses"))
    return labelled_gloss(definitions, labels).unionByName(steps)


def relation_summary(edges: DataFrame, pairs: DataFrame, law: DataFrame) -> DataFrame:
    """Of each pair (a, b): the strongest relation between them, either way, with its verdict, and how many neighbours they share."""
    asked = pairs.select("a", "b").distinct()
    best = reads.step_edge(edges, asked).withColumn("verdict", verdict()).withColumn("mu", F.round(eff_mu() / F.lit(1e9), 3)).select("a", "b", "type_id", "verdict", "mu")
    ends = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()
    ways = edges.filter("object_id is not null").select(F.col("subject_id").alias("id"), F.col("object_id").alias("near"))
    near = ways.union(ways.select(F.col("near").alias("id"), F.col("id").alias("near"))).distinct().join(ends, "id", "left_semi")
    shared = asked.join(near.withColumnRenamed("id", "a"), "a").join(near.withColumnRenamed("id", "b"), ["b", "near"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = asked.join(best, ["a", "b"], "left").join(shared, ["a", "b"], "left").join(F.broadcast(law.select("type_id", F.col("relation").alias("_relation"))), "type_id", "left")
    text = F.when(F.col("_relation").isNotNull(), F.concat(F.col("_relation"), F.lit("  ["), F.col("verdict"), F.lit("]"))).otherwise(F.lit("unrelated"))
    return rows.select("a", "b", text.alias("reply"), F.col("mu").alias("eff_mu"), F.coalesce("shared", F.lit(0).cast("long")).alias("witnesses"))


def context_exclude(prompt_ids: DataFrame, topics: DataFrame) -> DataFrame:
    """prompt_id, context: each prompt's ids (prompt_id, id) but its topic's (prompt_id, topic), sorted."""
    rows = prompt_ids.join(topics.select("prompt_id", F.col("topic").alias("id")), ["prompt_id", "id"], "left_anti")
    return rows.groupBy("prompt_id").agg(F.sort_array(F.collect_set("id")).alias("context"))


def respond(asked: DataFrame, responses: dict[str, DataFrame]) -> DataFrame:
    """asked (prompt_id, intent, topic) with the replies of each intent's responder; an intent without one, or without a
    reply, is answered by the responder named fallback."""
    every = None
    for intent, rows in responses.items():
        one = rows.withColumn("intent", F.lit(intent))
        every = one if every is None else every.unionByName(one)
    told = asked.join(every.filter("intent <> 'fallback'"), ["intent", "topic"])
    silent = asked.join(told.select("prompt_id").distinct(), "prompt_id", "left_anti")
    rest = silent.join(every.filter("intent = 'fallback'").drop("intent"), "topic")
    return told.select("prompt_id", "intent", "topic", "place", "reply", "eff_mu", "witnesses").unionByName(rest.select("prompt_id", "intent", "topic", "place", "reply", "eff_mu", "witnesses"))


def facts(edges: DataFrame, topics: DataFrame, tiers: dict[str, int], limit: int = 40) -> DataFrame:
    """Each topic's outgoing facts in tiers (band to tier; others last), the best of a tier first."""
    tier = F.coalesce(F.create_map(*[F.lit(x) for p in tiers.items() for x in p])[F.col("band")], F.lit(99))
    own = edges.filter(~refuted() & F.col("object_id").isNotNull()).join(topics.select(F.col("topic").alias("subject_id")).distinct(), "subject_id", "left_semi").withColumn("tier", tier)
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("tier", F.desc(F.round(edge_rank(), 9)), "object_id", "type_id"))
    return own.withColumn("place", place).filter(F.col("place") <= limit).select(F.col("subject_id").alias("topic"), "place", "tier", "relation", "object_id", F.round(eff_mu() / F.lit(1e9), 3).alias("eff_mu"), F.col("witness_count").alias("witnesses"))


def ladder(edges: DataFrame, topics: DataFrame, types: list[bytes], depth: int = 6) -> DataFrame:
    return graph.walk_strongest(edges, topics.select(F.col("topic").alias("id")), depth, types)
