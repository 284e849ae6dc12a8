"""Words, senses and concepts over the rated edges: translations, synonyms, labels and ranked senses.

Relations are given as type ids, so any vocabulary of relations will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import eff_mu, refuted


def _links(consensus: DataFrame, types: list[bytes], a: str, b: str) -> DataFrame:
    rows = consensus.filter(F.col("type_id").isin(*types) & F.col("object_id").isNotNull() & ~refuted())
    return rows.select(F.col("subject_id").alias(a), F.col("object_id").alias(b), eff_mu().alias("mu"), F.col("witness_count").alias("witnesses"))


def concept_members(consensus: DataFrame, concepts: DataFrame, kinds: dict[str, bytes]) -> DataFrame:
    """Members of each concept (concept), by kind of membership."""
    wanted = concepts.select("concept").distinct()
    out = None
    for kind, t in kinds.items():
        rows = _links(consensus, [t], "member", "concept").join(wanted, "concept", "left_semi").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("concept", "member", "kind").agg(F.max("mu").alias("mu"), F.sum("witnesses").alias("witnesses"))


def concept_peers(consensus: DataFrame, words: DataFrame, types: list[bytes], limit: int = 24) -> DataFrame:
    """Words that share a concept with each word (word): the number shared and the best of the weaker links.

    Words with the same concepts and ratings (a profile) have the same peers but for themselves. So profiles meet instead of
    words, and each hands on its first limit + 1 words only; what is quadratic is a concept's number of distinct profiles.
    """
    links = _links(consensus, types, "word", "concept").groupBy("word", "concept").agg(F.max("mu").alias("mu"))
    profiles = links.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("concept", "mu"))).alias("profile"))
    rank = F.row_number().over(Window.partitionBy("profile").orderBy("word"))
    first = profiles.withColumn("rank", rank).filter(F.col("rank") <= limit + 1).groupBy("profile").agg(F.sort_array(F.collect_list("word")).alias("first"))
    mine = profiles.join(words.select("word").distinct(), "word", "left_semi")
    own = mine.select("profile").distinct().select("profile", F.inline("profile"))
    others = first.select(F.col("profile").alias("other"), "first", F.inline("profile")).withColumnRenamed("mu", "peer_mu")
    # words of the first list of a profile stand for all of them, also where the profile meets itself
    meets = own.join(others, "concept").groupBy("profile", "other").agg(F.count("*").alias("shared"), F.max(F.least("mu", "peer_mu")).alias("strength"), F.first("first").alias("first"))
    peers = meets.select("profile", "shared", "strength", F.explode("first").alias("peer"))
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("shared"), F.desc("strength"), "peer"))
    best = peers.withColumn("place", place).filter(F.col("place") <= limit + 1).groupBy("profile").agg(F.sort_array(F.collect_list(F.struct("place", "peer", "shared", "strength"))).alias("best"))
    left = F.slice(F.filter("best", lambda x: x["peer"] != F.col("word")), 1, limit)
    return mine.join(best, "profile").select("word", F.explode(left).alias("x")).select("word", "x.peer", "x.shared", "x.strength")


def translations(consensus: DataFrame, words: DataFrame, sense: list[bytes], languages: DataFrame, same: bool = False, to: str | None = None, limit: int = 24) -> DataFrame:
    """Words of other languages (of the same one, if same) that share a sense with each word. languages: (word, lang).

    A pair's rating is its best one over all senses that are shared, so a word among the best `limit` is one of the best
    limit + 1 of its language in that sense: a sense hands on no more than these, however many words it has.
    """
    every = _links(consensus, sense, "word", "synset")
    links = every.groupBy("word", "synset").agg(F.max("mu").alias("mu"))
    lang = languages.select("word", "lang").distinct()
    mine = links.join(words.select("word").distinct(), "word", "left_semi").join(lang, "word").select("word", "synset", "lang")
    others = links.join(lang, "word").select(F.col("word").alias("other"), "synset", F.col("lang").alias("language"), "mu")
    others = others if to is None else others.filter(F.col("language") == to)
    rank = F.row_number().over(Window.partitionBy("synset", "language").orderBy(F.desc("mu"), "other"))
    few = others.withColumn("rank", rank).filter(F.col("rank") <= limit + 1).drop("rank")
    rows = mine.join(few, "synset").filter("other <> word").filter(F.col("language") == F.col("lang") if same else F.col("language") != F.col("lang"))
    best = rows.groupBy("word", "other", "language").agg(F.max("mu").alias("mu"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("mu"), "language", "other"))
    kept = best.withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    # what the pairs that are left share
    shared = kept.select("word", "other").distinct().join(every.select("word", "synset"), "word").join(every.select(F.col("word").alias("other"), "synset", "witnesses"), ["other", "synset"])
    return kept.join(shared.groupBy("word", "other").agg(F.sum("witnesses").alias("witnesses")), ["word", "other"]).select("word", "other", "language", "mu", "witnesses")


def language_coverage(consensus: DataFrame, concepts: DataFrame, types: list[bytes], languages: DataFrame) -> DataFrame:
    """How many languages have a word for each concept, and which."""
    rows = _links(consensus, types, "word", "concept").join(concepts.select("concept").distinct(), "concept", "left_semi").join(languages.select("word", "lang").distinct(), "word")
    return rows.groupBy("concept").agg(F.countDistinct("lang").alias("languages"), F.concat_ws(", ", F.sort_array(F.collect_set("lang"))).alias("reply"), F.max("mu").alias("mu"))


def bubble_up(consensus: DataFrame, terms: DataFrame, sense: list[bytes], synset: list[bytes], domain: DataFrame | None = None, k: int | None = None, boost: float = 0.1) -> DataFrame:
    """Each term's (term) senses and their synsets, the best first; neighbours in the domain (id) raise the score."""
    senses = _links(consensus, sense, "term", "sense_id").join(terms.select("term").distinct(), "term", "left_semi").select("term", "sense_id", "mu", "witnesses")
    ups = _links(consensus, synset, "sense_id", "synset_id").select("sense_id", "synset_id", F.col("mu").alias("up_mu"))
    rows = senses.join(ups, "sense_id", "left").withColumn("synset_id", F.coalesce("synset_id", "sense_id"))
    if domain is None:
        rows = rows.withColumn("domain_hits", F.lit(0).cast("long"))
    else:
        near = consensus.filter(~refuted()).join(domain.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi").groupBy(F.col("subject_id").alias("synset_id")).agg(F.countDistinct("object_id").alias("domain_hits"))
        rows = rows.join(near, "synset_id", "left").withColumn("domain_hits", F.coalesce("domain_hits", F.lit(0).cast("long")))
    rows = rows.withColumn("score", F.col("mu") / F.lit(1e9) * (1 + F.lit(boost) * F.col("domain_hits")))
    if k is None:
        return rows
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "sense_id", "synset_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def top_synset(consensus: DataFrame, words: DataFrame, types: list[bytes]) -> DataFrame:
    rows = _links(consensus, types, "word", "synset").join(words.select("word").distinct(), "word", "left_semi")
    return rows.groupBy("word").agg(F.max_by("synset", F.struct("mu", "synset")).alias("synset"), F.max("mu").alias("mu"))


def labels(ids: DataFrame, names: DataFrame, consensus: DataFrame | None = None, name_types: list[bytes] | None = None) -> DataFrame:
    """ids (id) with a label: its canonical name, else that of its best name edge, else its digits."""
    own = ids.select("id").distinct().join(names.select("id", F.col("name").alias("canonical")), "id", "left")
    if consensus is not None and name_types:
        alias = _links(consensus, name_types, "id", "name_id").join(names.select(F.col("id").alias("name_id"), "name"), "name_id")
        best = alias.groupBy("id").agg(F.max_by("name", F.struct("mu", "name")).alias("alias"))
        own = own.join(best, "id", "left")
    else:
        own = own.withColumn("alias", F.lit(None).cast("string"))
    return own.select("id", F.coalesce("canonical", "alias", F.lower(F.hex("id"))).alias("label"))


# --- senses with their definitions, examples, members -------------------------------------------------------------


def senses(consensus: DataFrame, words: DataFrame, sense: list[bytes], synset: list[bytes], context: DataFrame | None = None) -> DataFrame:
    """word, sense_id, synset_id, eff_mu (three decimals), witnesses and score of each word's (word) senses.

    context (id): ids that raise the score of synsets that have an edge to them.
    """
    rows = bubble_up(consensus, words.select(F.col("word").alias("term")), sense, synset, context)
    shown = F.round(F.col("mu") / F.lit(1e9), 3)
    return rows.select(F.col("term").alias("word"), "sense_id", "synset_id", shown.alias("eff_mu"), "witnesses", "score")


def _texts_of_senses(consensus: DataFrame, found: DataFrame, types: list[bytes]) -> DataFrame:
    """word, object_id, eff_mu, witnesses, sense_rank: what edges of some types say of each word's senses and synsets."""
    ends = found.select("word", F.explode(F.array_distinct(F.array("sense_id", "synset_id"))).alias("subject"), F.col("eff_mu").alias("sense_rank"))
    said = _links(consensus, types, "subject", "object_id").withColumn("eff_mu", F.round(F.col("mu") / F.lit(1e9), 3)).drop("mu")
    return ends.join(said, "subject").select("word", "object_id", "eff_mu", "witnesses", "sense_rank")


def _best_texts(rows: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    rank = F.round(F.coalesce("sense_rank", F.lit(0.0)) + F.col("eff_mu"), 3)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(rank), "object_id", F.desc("witnesses"), F.desc(F.coalesce("sense_rank", F.lit(0.0)))))
    best = rows.withColumn("place", place).filter(F.col("place") <= limit)
    return best.join(texts.select(F.col("id").alias("object_id"), F.col("name").alias("text")), "object_id", "left").select("word", "place", "text", "eff_mu", "witnesses")


def definitions(consensus: DataFrame, words: DataFrame, sense: list[bytes], synset: list[bytes], defines: list[bytes], texts: DataFrame, peers: DataFrame | None = None, context: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Each word's definitions, those of its senses and synsets and of its own, the best first: word, place, text, eff_mu, witnesses.

    texts: (id, name); peers: (word, peer), forms whose own definitions count as the word's.
    """
    arms = _texts_of_senses(consensus, senses(consensus, words, sense, synset, context), defines)
    forms = words.select("word", F.col("word").alias("peer"))
    forms = (forms if peers is None else forms.unionByName(peers.select("word", "peer").join(words.select("word"), "word", "left_semi"))).distinct()
    own = _links(consensus, defines, "peer", "object_id").join(forms, "peer")
    own = own.select("word", "object_id", F.round(F.col("mu") / F.lit(1e9), 3).alias("eff_mu"), "witnesses", F.lit(None).cast("double").alias("sense_rank"))
    return _best_texts(arms.unionByName(own), texts, limit)


def examples(consensus: DataFrame, words: DataFrame, sense: list[bytes], synset: list[bytes], shows: list[bytes], texts: DataFrame, limit: int = 5) -> DataFrame:
    """Each word's examples, those of its best senses first."""
    return _best_texts(_texts_of_senses(consensus, senses(consensus, words, sense, synset), shows), texts, limit)


def sense_audit(consensus: DataFrame, words: DataFrame, sense: list[bytes], synset: list[bytes], language: list[bytes], law: DataFrame, limit: int = 64) -> DataFrame:
    """Why senses were found: word, place, synset_id, via (best relation from the word itself), language_id, eff_mu, witnesses."""
    found = senses(consensus, words, sense, synset)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("eff_mu"), "synset_id", "sense_id"))
    top = found.withColumn("place", place).filter(F.col("place") <= limit)
    edges = consensus.filter(~refuted()).join(law.select("type_id", "relation"), "type_id", "left")
    via = edges.groupBy(F.col("subject_id").alias("word"), F.col("object_id").alias("synset_id")).agg(F.min_by("relation", F.struct(-eff_mu(), "type_id")).alias("via"))
    tongue = _links(consensus, language, "synset_id", "language_id").groupBy("synset_id").agg(F.min_by("language_id", F.struct(-F.col("mu"), "language_id")).alias("language_id"))
    return top.join(via, ["word", "synset_id"], "left").join(tongue, "synset_id", "left").select("word", "place", "synset_id", "via", "language_id", "eff_mu", "witnesses")


def synset_members(consensus: DataFrame, words: DataFrame, sense: list[bytes], synset: list[bytes], synonym: list[bytes], instance: list[bytes] | None = None) -> DataFrame:
    """Other words of each word's synsets, and what is said to be a synonym either way: word, member, mu, witnesses.

    instance: relations whose subjects are single instances; senses of such synsets are left out.
    """
    mine = senses(consensus, words, sense, synset).select("word", "synset_id").distinct()
    if instance:
        mine = mine.join(_links(consensus, instance, "synset_id", "of").filter("mu > 0"), "synset_id", "left_anti")
    into = _links(consensus, synset, "sense_id", "synset_id").select("sense_id", "synset_id")
    held = _links(consensus, sense, "member", "sense_id").join(into, "sense_id").join(mine, "synset_id").select("word", "member", "mu", "witnesses")
    pairs = _links(consensus, synonym, "a", "b")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("member"), "mu", "witnesses").unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("member"), "mu", "witnesses"))
    rows = held.unionByName(both.join(words.select("word").distinct(), "word", "left_semi")).filter("member <> word")
    return rows.groupBy("word", "member").agg(F.max("mu").alias("mu"), F.sum("witnesses").alias("witnesses"))


def case_variants(words: DataFrame, text: str = "text") -> DataFrame:
    """text, variant: each text as it is, in lower, upper and title case, and with a capital first letter; each form once."""
    t = F.col(text)
    first = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(F.lower(t), 2, 1 << 30))
    forms = F.array_distinct(F.array(t, F.lower(t), F.upper(t), F.initcap(t), first))
    return words.select(t.alias("text"), F.explode(forms).alias("variant"))


def lexical_peers(words: DataFrame, consensus: DataFrame, sense: list[bytes], prefix: str = "word:") -> DataFrame:
    """word, peer: case variants of each word (word, text) that have senses of their own."""
    from ..functions.ids import canonical_id

    forms = words.join(case_variants(words.select("text").distinct()), "text").withColumn("peer", canonical_id(F.concat(F.lit(prefix), "variant")))
    known = _links(consensus, sense, "peer", "sense_id").select("peer").distinct()
    return forms.select("word", "peer").distinct().join(known, "peer", "left_semi")


def type_labels(law: DataFrame) -> DataFrame:
    """type_id, label: relation names as words."""
    return law.select("type_id", F.lower(F.translate("relation", "_", " ")).alias("label"))
