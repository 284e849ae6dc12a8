"""A lexicon made of the parts' names and types, and the queries that read words, senses, names and replies from it.

A word of a part's name has a sense for each type of part it names; senses belong to the type's synset; definitions,
examples and names come from brands and sizes. Ratings are in closed form, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rating import INITIAL_RD, INITIAL_VOLATILITY, NEUTRAL
from ..operators import edges, graph, lexical, model, realize, recall
from .edge_queries import _EFF, _NOT_REFUTED, _hex
from .registry import query
from .world import table, type_id

RELATIONS = {
    "HAS_SENSE": "equivalence",
    "IS_SENSE_OF": "equivalence",
    "HAS_DEFINITION": "definitional",
    "HAS_EXAMPLE": "lexical_glue",
    "HAS_NAME": "definitional",
    "HAS_NAME_ALIAS": "definitional",
    "HAS_LANGUAGE": "scalar_valued",
    "IS_TRANSLATION_OF": "equivalence",
    "IS_SYNONYM_OF": "equivalence",
    "CAUSES": "causal",
    "HAS_PREREQUISITE": "causal",
    "IS_A": "taxonomic",
}
#: What every part's row says of each word w of its name: subject, relation, object; in words that both engines read.
_OF_WORDS = [
    ("'word:' || w", "HAS_SENSE", "'sense:' || w || '@' || p_type"),
    ("'sense:' || w || '@' || p_type", "IS_SENSE_OF", "'synset:' || p_type"),
    ("'sense:' || w || '@' || p_type", "HAS_EXAMPLE", "'text:a %s of size ' || p_size"),
    ("'word:' || w", "HAS_DEFINITION", "'text:sold as ' || p_brand"),
    ("'word:' || w", "HAS_LANGUAGE", "'lang:' || substr(w, 1, 1)"),
    ("'synset:' || p_type", "IS_TRANSLATION_OF", "'word:' || w"),
]
#: And of the name's first and last word, once a row.
_OF_PARTS = [
    ("'synset:' || p_type", "HAS_DEFINITION", "'text:made by ' || p_brand"),
    ("'synset:' || p_type", "HAS_NAME", "'text:' || lower(p_type)"),
    ("'synset:' || p_type", "HAS_NAME_ALIAS", "'text:' || p_brand"),
    ("'word:' || w1", "IS_SYNONYM_OF", "'word:' || w2"),
    ("'word:' || w1", "CAUSES", "'word:' || w2"),
    ("'word:' || w2", "HAS_PREREQUISITE", "'word:' || w1"),
    ("'word:' || w2", "IS_A", "'kind:' || substr(w2, 1, 1)"),
    ("'kind:' || substr(w2, 1, 1)", "IS_A", "'kind:thing'"),
]
_ROWS = "p AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', -1) AS w2, CAST(round((0.5e0 + p_size / 100e0) * 1e9) AS BIGINT) AS sc FROM part)"
_RANKS = " ".join(f"WHEN '{r}' THEN {model.BAND_RANKS[b]}" for r, b in RELATIONS.items())
_ARMS = " UNION ALL ".join([f"SELECT {s} AS subject, '{r}' AS relation, {o} AS object, sc FROM pw" for s, r, o in _OF_WORDS] + [f"SELECT {s}, '{r}', {o}, sc FROM p" for s, r, o in _OF_PARTS])
SQL = f"""{_ROWS}, pw AS (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM p),
lexsaid AS ({_ARMS}),
consensus AS (SELECT md5(subject) AS subject_id, md5(relation) AS type_id, md5(object) AS object_id, relation, CAST({NEUTRAL} + floor((2 * (s / g) / 1e9 - 1) * 400e9 * g / (g + 2)) AS BIGINT) AS rating, CAST(floor({INITIAL_RD}e0 / sqrt(1.0 + g)) AS BIGINT) AS rd, g AS witness_count, CASE relation {_RANKS} ELSE 0.0 END::DOUBLE AS rank
    FROM (SELECT subject, relation, object, count(*) AS g, CAST(sum(sc) AS BIGINT) AS s FROM lexsaid GROUP BY ALL)),
names AS (SELECT DISTINCT md5(n) AS id, substr(n, instr(n, ':') + 1) AS name FROM (SELECT subject AS n FROM lexsaid UNION SELECT object FROM lexsaid)),
words AS (SELECT DISTINCT md5('word:' || w) AS word, w AS text FROM pw),
links AS (SELECT subject_id, object_id, relation, {_EFF} AS mu, round({_EFF} / 1e9, 3) AS eff_mu, witness_count AS witnesses, rank FROM consensus WHERE {_NOT_REFUTED}),
senses AS (SELECT a.subject_id AS word, a.object_id AS sense_id, coalesce(b.object_id, a.object_id) AS synset_id, a.mu, a.eff_mu, a.witnesses FROM links a JOIN words ON word = a.subject_id LEFT JOIN links b ON b.subject_id = a.object_id AND b.relation = 'IS_SENSE_OF' WHERE a.relation = 'HAS_SENSE')"""


def _sql(body: str) -> str:
    return f"WITH {SQL} {body}" if body.lstrip().startswith("SELECT") else f"WITH {SQL}, {body}"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumns({"w1": F.substring_index("p_name", " ", 1), "w2": F.substring_index("p_name", " ", -1)})
    return rows.withColumn("sc", F.round((F.lit(0.5) + F.col("p_size") / 100) * 1e9).cast("long"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, relation, object and sc, a row for each thing that a part's row says: all arms are one pass over the parts."""
    rows = parts(spark, sf_dir)
    each = rows.withColumn("w", F.explode(F.split("p_name", " ")))
    one = lambda s, r, o: F.struct(F.expr(s).alias("subject"), F.lit(r).alias("relation"), F.expr(o).alias("object"))
    a = each.select(F.explode(F.array(*[one(*x) for x in _OF_WORDS])).alias("x"), "sc")
    b = rows.select(F.explode(F.array(*[one(*x) for x in _OF_PARTS])).alias("x"), "sc")
    return a.unionByName(b).select("x.*", "sc")


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = said(spark, sf_dir).groupBy("subject", "relation", "object").agg(F.count("*").alias("g"), F.sum("sc").alias("s"))
    rating = F.lit(NEUTRAL) + F.floor((2 * (F.col("s") / F.col("g")) / F.lit(1e9) - 1) * F.lit(400e9) * F.col("g") / (F.col("g") + 2))
    out = q.select(ids.canonical_id("subject").alias("subject_id"), ids.relation_type_id("relation").alias("type_id"), ids.canonical_id("object").alias("object_id"), rating.cast("long").alias("rating"), F.floor(F.lit(float(INITIAL_RD)) / F.sqrt(1.0 + F.col("g"))).cast("long").alias("rd"), F.lit(INITIAL_VOLATILITY).cast("long").alias("volatility"), F.col("g").alias("witness_count"))
    # read several times by most queries, and no larger than what the parts' names, types and brands combine to
    return model.cut(out.withColumn("id", ids.triple_id()), "lexicon")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = said(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("n")).distinct()
    return every.select(ids.canonical_id("n").alias("id"), F.expr("substring(n, instr(n, ':') + 1)").alias("name"))


def law(spark: SparkSession) -> DataFrame:
    return model.relation_law(spark, RELATIONS)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = parts(spark, sf_dir).select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    return each.select(ids.canonical_id(F.concat(F.lit("word:"), "text")).alias("word"), "text")


def _t(*relations: str) -> list[bytes]:
    return [type_id(r) for r in relations]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).withColumnRenamed("name", "label")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).withColumnRenamed("name", "text")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(F.col("word").alias("topic"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.ranked(consensus(spark, sf_dir), law(spark))


def _reply(rows: DataFrame) -> DataFrame:
    return _hex(rows.select("topic", F.col("place").cast("int").alias("place"), "reply", "eff_mu", "witnesses"))


# --- words and senses ---------------------------------------------------------------------------------------------


@query(_sql("SELECT word, sense_id, synset_id, eff_mu, witnesses FROM senses"))
def lexical_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.senses(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"))
    return _hex(rows.drop("score"))


@query(_sql("hits AS (SELECT subject_id AS synset_id, count(DISTINCT object_id) AS n FROM links WHERE object_id IN (SELECT md5('text:made by Brand#' || b) FROM unnest(['11', '12', '5']) t(b)) GROUP BY 1) SELECT word, sense_id, s.synset_id, round(mu / 1e9 * (1 + 0.1e0 * coalesce(n, 0)), 6) AS score FROM senses s LEFT JOIN hits USING (synset_id)"))
def lexical_senses_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spark.createDataFrame([(f"text:made by Brand#{b}",) for b in ("11", "12", "5")], "n string").select(ids.canonical_id("n").alias("id"))
    rows = lexical.senses(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"), near)
    return _hex(rows.select("word", "sense_id", "synset_id", F.round("score", 6).alias("score")))


_DEFS = """arms AS (
    SELECT s.word, l.object_id, l.eff_mu, l.witnesses, s.eff_mu AS sense_rank FROM senses s JOIN links l ON l.relation = 'HAS_DEFINITION' AND (l.subject_id = s.sense_id OR l.subject_id = s.synset_id)
    UNION ALL SELECT word, l.object_id, l.eff_mu, l.witnesses, NULL FROM words JOIN links l ON l.subject_id = word AND l.relation = 'HAS_DEFINITION'),
defs AS (SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY round(coalesce(sense_rank, 0) + eff_mu, 3) DESC, object_id, witnesses DESC, coalesce(sense_rank, 0) DESC) AS INTEGER) AS place, name AS text, eff_mu, witnesses FROM arms LEFT JOIN names ON id = object_id)"""


def _definitions(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    return lexical.definitions(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"), _t("HAS_DEFINITION"), names(spark, sf_dir), limit=limit)


@query(_sql(f"{_DEFS} SELECT word, place, text, eff_mu, witnesses FROM defs WHERE place <= 5"))
def define(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(_definitions(spark, sf_dir).withColumn("place", F.col("place").cast("int")))


@query(_sql("""ex AS (SELECT s.word, CAST(row_number() OVER (PARTITION BY word ORDER BY round(s.eff_mu + l.eff_mu, 3) DESC, l.object_id, l.witnesses DESC, s.eff_mu DESC) AS INTEGER) AS place, name AS text, l.eff_mu, l.witnesses FROM senses s JOIN links l ON l.relation = 'HAS_EXAMPLE' AND (l.subject_id = s.sense_id OR l.subject_id = s.synset_id) LEFT JOIN names ON id = l.object_id)
SELECT e.word AS topic, place, replace(e.text, '%s', w.text) AS reply, eff_mu, witnesses FROM ex e JOIN words w USING (word) WHERE place <= 5"""))
def recall_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.examples(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"), _t("HAS_EXAMPLE"), names(spark, sf_dir))
    return _reply(recall.examples(found, _labels(spark, sf_dir)))


@query(_sql("""top AS (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY eff_mu DESC, synset_id, sense_id) AS INTEGER) AS place FROM senses),
via AS (SELECT subject_id AS word, object_id AS synset_id, arg_min(relation, (-mu, md5(relation))) AS via FROM links GROUP BY ALL)
SELECT word, place, synset_id, via, CAST(NULL AS VARCHAR) AS language_id, eff_mu, witnesses FROM top LEFT JOIN via USING (word, synset_id) WHERE place <= 4"""))
def sense_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.sense_audit(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"), _t("HAS_LANGUAGE"), law(spark), 4)
    return _hex(rows.withColumn("place", F.col("place").cast("int")))


_MEMBERS = """mine AS (SELECT DISTINCT word, synset_id FROM senses),
held AS (SELECT m.word, h.subject_id AS member, h.mu, h.witnesses FROM mine m JOIN links u ON u.object_id = m.synset_id AND u.relation = 'IS_SENSE_OF' JOIN links h ON h.object_id = u.subject_id AND h.relation = 'HAS_SENSE'),
side AS (SELECT subject_id AS word, object_id AS member, mu, witnesses FROM links WHERE relation = 'IS_SYNONYM_OF' UNION ALL SELECT object_id, subject_id, mu, witnesses FROM links WHERE relation = 'IS_SYNONYM_OF'),
members AS (SELECT word, member, max(mu) AS mu, CAST(sum(witnesses) AS BIGINT) AS witnesses FROM (FROM held UNION ALL SELECT * FROM side WHERE word IN (SELECT word FROM words)) WHERE member <> word GROUP BY ALL)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.synset_members(consensus(spark, sf_dir), words(spark, sf_dir), _t("HAS_SENSE"), _t("IS_SENSE_OF"), _t("IS_SYNONYM_OF"))


@query(_sql(f"{_MEMBERS} SELECT word, member, mu, witnesses FROM members"))
def synset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(_members(spark, sf_dir))


@query("SELECT DISTINCT text, v AS variant FROM (SELECT text, unnest([text, lower(text), upper(text), upper(substr(text, 1, 1)) || lower(substr(text, 2))]) AS v FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS text FROM part))")
def word_case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.case_variants(words(spark, sf_dir))


@query(_sql("SELECT word, word AS peer FROM words WHERE word IN (SELECT subject_id FROM links WHERE relation = 'HAS_SENSE')"))
def lexical_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(lexical.lexical_peers(words(spark, sf_dir), consensus(spark, sf_dir), _t("HAS_SENSE")))


@query("SELECT md5(r) AS type_id, lower(replace(r, '_', ' ')) AS label FROM unnest([" + ", ".join(f"'{r}'" for r in RELATIONS) + "]) t(r)")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(lexical.type_labels(law(spark)))


# --- names --------------------------------------------------------------------------------------------------------

_SPOKEN = "tongue AS (SELECT subject_id AS cand FROM consensus WHERE relation = 'HAS_LANGUAGE' AND object_id = md5('lang:b'))"


def _ladder(cte: str, rows: str) -> str:
    """Each id's first candidate with a text, of rows (id, cand, preferred, mu)."""
    return f"{cte} AS (SELECT id, arg_min(text, (NOT spoken, NOT preferred, -mu, cand)) AS text FROM (SELECT r.*, n.name AS text, cand IN (SELECT cand FROM tongue) AS spoken FROM ({rows}) r JOIN names n ON n.id = r.cand AND n.name <> '') GROUP BY id)"


_HAS_NAME = _ladder("has_name", "SELECT subject_id AS id, object_id AS cand, relation = 'HAS_NAME' AS preferred, mu FROM links WHERE relation IN ('HAS_NAME', 'HAS_NAME_ALIAS')")
_LEMMA = _ladder("lemma", f"SELECT u.object_id AS id, c.subject_id AS cand, TRUE AS preferred, c.rating - 2 * c.rd AS mu FROM links u JOIN consensus c ON c.object_id = u.subject_id AND c.relation = 'HAS_SENSE' WHERE u.relation = 'IS_SENSE_OF'")
_TRANSLATED = _ladder("translated", "SELECT subject_id AS id, object_id AS cand, TRUE AS preferred, mu FROM links WHERE relation = 'IS_TRANSLATION_OF'")
_DEFINED = "defined AS (SELECT d.id, name AS text FROM (SELECT subject_id AS id, arg_min(object_id, (-mu, object_id)) AS cand FROM links WHERE relation = 'HAS_DEFINITION' GROUP BY 1) d LEFT JOIN names n ON n.id = cand)"


def _tongue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .world import entity

    return realize.speakers(consensus(spark, sf_dir), type_id("HAS_LANGUAGE"), entity("lang:b"))


@query(_sql(f"{_SPOKEN}, {_HAS_NAME} SELECT id, text FROM has_name"))
def realize_has_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(realize.has_name(consensus(spark, sf_dir), _texts(spark, sf_dir), type_id("HAS_NAME"), type_id("HAS_NAME_ALIAS"), _tongue(spark, sf_dir)))


@query(_sql(f"{_SPOKEN}, {_LEMMA} SELECT id, text FROM lemma"))
def realize_synset_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(realize.synset_lemma(consensus(spark, sf_dir), _texts(spark, sf_dir), type_id("HAS_SENSE"), type_id("IS_SENSE_OF"), _tongue(spark, sf_dir)))


@query(_sql(f"{_SPOKEN}, {_TRANSLATED} SELECT id, text FROM translated"))
def realize_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(realize.translation(consensus(spark, sf_dir), _texts(spark, sf_dir), type_id("IS_TRANSLATION_OF"), _tongue(spark, sf_dir)))


@query(_sql(f"{_DEFINED} SELECT id, text FROM defined"))
def realize_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(realize.defines(consensus(spark, sf_dir), _texts(spark, sf_dir), type_id("HAS_DEFINITION")))


@query("SELECT md5('substrate/source/' || p_brand || '/v1') AS id, p_brand AS text FROM part GROUP BY p_brand")
def realize_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.concat(F.lit("substrate/source/"), "p_brand", F.lit("/v1")).alias("name"), "p_type")
    every = rows.select("name").union(rows.select("p_type")).distinct().select(ids.canonical_id("name").alias("id"), "name")
    return _hex(realize.canonical(every))


@query(_sql(f"{_SPOKEN}, {_HAS_NAME}, {_LEMMA}, every AS (SELECT DISTINCT object_id AS id FROM consensus WHERE relation = 'IS_SENSE_OF') SELECT id, coalesce(h.text, l.text) AS text FROM every LEFT JOIN has_name h USING (id) LEFT JOIN lemma l USING (id)"))
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = consensus(spark, sf_dir)
    every = c.filter(F.col("type_id") == F.lit(type_id("IS_SENSE_OF"))).select(F.col("object_id").alias("id"))
    return _hex(realize.resolve_name(every, c, _texts(spark, sf_dir), *_t("HAS_NAME", "HAS_NAME_ALIAS", "HAS_SENSE", "IS_SENSE_OF"), _tongue(spark, sf_dir)))


@query(_sql(f"{_SPOKEN}, {_HAS_NAME}, {_LEMMA}, {_TRANSLATED}, {_DEFINED}, own AS (SELECT id, name AS text FROM names WHERE id IN (SELECT word FROM words)), every AS (SELECT DISTINCT subject_id AS id FROM consensus) SELECT id, coalesce(o.text, h.text, l.text, t.text, d.text) AS text FROM every LEFT JOIN own o USING (id) LEFT JOIN has_name h USING (id) LEFT JOIN lemma l USING (id) LEFT JOIN translated t USING (id) LEFT JOIN defined d USING (id)"))
def realize_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that only words and definitions' texts have of their own: the other steps come into play for all else."""
    c, n = consensus(spark, sf_dir), names(spark, sf_dir)
    texts = _texts(spark, sf_dir)
    tongue = _tongue(spark, sf_dir)
    own = texts.join(words(spark, sf_dir).select(F.col("word").alias("id")), "id", "left_semi")
    roles = dict(zip(("name", "alias", "sense", "synset", "translation", "definition"), _t("HAS_NAME", "HAS_NAME_ALIAS", "HAS_SENSE", "IS_SENSE_OF", "IS_TRANSLATION_OF", "HAS_DEFINITION"), strict=True))
    every = c.select(F.col("subject_id").alias("id"))
    named = realize.resolve_name(every, c, texts, roles["name"], roles["alias"], roles["sense"], roles["synset"], tongue)
    return _hex(realize.coalesced(every, own, named, realize.translation(c, texts, roles["translation"], tongue), realize.canonical(n), realize.defines(c, texts, roles["definition"])))


# --- replies ------------------------------------------------------------------------------------------------------


@query(_sql(f"{_DEFS} SELECT word AS topic, place, text AS reply, eff_mu, witnesses FROM defs WHERE place <= 5"))
def recall_define(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.gloss(_definitions(spark, sf_dir)))


@query(_sql(f"{_DEFS} SELECT d.word AS topic, place, w.text || ': ' || d.text AS reply, eff_mu, witnesses FROM defs d JOIN words w USING (word) WHERE place <= 3"))
def recall_fallback_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.labelled_gloss(_definitions(spark, sf_dir, 3), _labels(spark, sf_dir)))


@query(_sql(f"""r AS (SELECT subject_id AS topic, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY round(rank * mu / 1e9, 9) DESC, object_id, md5(relation)) AS INTEGER) AS place, lower(replace(relation, '_', ' ')) || ': ' || coalesce(name, object_id) AS reply, eff_mu, witnesses FROM links LEFT JOIN names ON id = object_id WHERE relation NOT IN ('HAS_SENSE', 'HAS_LANGUAGE') AND subject_id IN (SELECT word FROM words)) SELECT * FROM r WHERE place <= 24"""))
def recall_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.describe(_rated(spark, sf_dir), _topics(spark, sf_dir), _labels(spark, sf_dir), _t("HAS_SENSE", "HAS_LANGUAGE")))


def _related_sql(end: str, other: str) -> str:
    return _sql(f"r AS (SELECT {end} AS topic, CAST(row_number() OVER (PARTITION BY {end} ORDER BY mu DESC, {other}) AS INTEGER) AS place, name AS reply, eff_mu, witnesses FROM links JOIN names ON id = {other} WHERE relation = 'CAUSES' AND {end} IN (SELECT word FROM words)) SELECT * FROM r WHERE place <= 24")


@query(_related_sql("subject_id", "object_id"))
def recall_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.related(_rated(spark, sf_dir), _topics(spark, sf_dir), _labels(spark, sf_dir), type_id("CAUSES")))


@query(_related_sql("object_id", "subject_id"))
def recall_related_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.related(_rated(spark, sf_dir), _topics(spark, sf_dir), _labels(spark, sf_dir), type_id("CAUSES"), True))


@query(_sql("""r AS (SELECT subject_id AS topic, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY round(rank * mu / 1e9, 9) DESC, mu DESC, object_id, md5(relation)) AS INTEGER) AS place, t.name || ' — ' || CASE relation WHEN 'CAUSES' THEN 'causes' ELSE 'requires' END || ' ' || o.name AS reply, eff_mu, witnesses FROM links JOIN names o ON o.id = object_id JOIN names t ON t.id = subject_id WHERE relation IN ('CAUSES', 'HAS_PREREQUISITE')) SELECT * FROM r WHERE place <= 8"""))
def recall_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.interaction(_rated(spark, sf_dir), _topics(spark, sf_dir), _labels(spark, sf_dir)))


@query(_sql(f"{_MEMBERS}, r AS (SELECT word AS topic, CAST(row_number() OVER (PARTITION BY word ORDER BY mu DESC, witnesses DESC, member) AS INTEGER) AS place, name AS reply, round(mu / 1e9, 3) AS eff_mu, witnesses FROM members JOIN names ON id = member) SELECT * FROM r WHERE place <= 24"))
def recall_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.synonyms(_members(spark, sf_dir), _labels(spark, sf_dir)))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word", F.substring("text", 1, 1).alias("lang"))


@query(_sql("""l AS (SELECT subject_id AS word, object_id AS synset, mu, witnesses, substr(text, 1, 1) AS lang FROM links JOIN words ON word = subject_id WHERE relation IN ('CAUSES', 'IS_SYNONYM_OF')),
r AS (SELECT a.word, b.word AS other, b.lang AS language, max(b.mu) AS mu, CAST(sum(b.witnesses) AS BIGINT) AS witnesses FROM l a JOIN l b USING (synset) WHERE a.word <> b.word AND a.lang <> b.lang GROUP BY ALL),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY mu DESC, language, other) AS INTEGER) AS place FROM r)
SELECT pl.word AS topic, place, text || ' [' || language || ']' AS reply, round(mu / 1e9, 3) AS eff_mu, witnesses FROM pl JOIN words w ON w.word = other WHERE place <= 24"""))
def recall_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.translations(consensus(spark, sf_dir), words(spark, sf_dir), _t("CAUSES", "IS_SYNONYM_OF"), _spoken(spark, sf_dir))
    return _reply(recall.translations(found, _labels(spark, sf_dir)))


@query(_sql("""SELECT object_id AS topic, CAST(1 AS INTEGER) AS place, array_to_string(list_sort(list(DISTINCT substr(text, 1, 1))), ', ') AS reply, round(max(mu) / 1e9, 3) AS eff_mu, count(DISTINCT substr(text, 1, 1)) AS witnesses FROM links JOIN words ON word = subject_id WHERE relation = 'CAUSES' GROUP BY object_id"""))
def recall_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = consensus(spark, sf_dir)
    concepts = words(spark, sf_dir).select(F.col("word").alias("concept"))
    return _reply(recall.languages(lexical.language_coverage(c, concepts, _t("CAUSES"), _spoken(spark, sf_dir))))


_UP = "up AS (SELECT l.subject_id AS a, l.object_id AS b, l.mu FROM links l WHERE relation = 'IS_A' QUALIFY row_number() OVER (PARTITION BY l.subject_id ORDER BY mu DESC, object_id) = 1)"


@query(_sql(f"""{_UP}, s1 AS (SELECT word AS topic, w.text AS said, b, mu FROM words w JOIN up ON a = word), s2 AS (SELECT topic, up.b, least(s1.mu, up.mu) AS mu, said, s1.b AS mid FROM s1 JOIN up ON a = s1.b),
r AS (SELECT topic, said || ' —is a→ ' || m.name || ' —is a→ ' || n.name AS reply, mu FROM s2 JOIN names n ON n.id = b JOIN names m ON m.id = mid UNION ALL SELECT topic, said || ' —is a→ ' || n.name, mu FROM s1 JOIN names n ON n.id = b WHERE b NOT IN (SELECT a FROM up))
SELECT topic, CAST(1 AS INTEGER) AS place, reply, round(mu / 1e9, 3) AS eff_mu, CAST(NULL AS BIGINT) AS witnesses FROM r"""))
def recall_fallback_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.walk(recall.ladder(_rated(spark, sf_dir), _topics(spark, sf_dir), _t("IS_A")), _labels(spark, sf_dir), law(spark)))


@query(_sql(f"""{_DEFS}, {_UP}, s1 AS (SELECT word AS topic, b FROM words JOIN up ON a = word), s2 AS (SELECT topic, up.b FROM s1 JOIN up ON a = s1.b)
SELECT d.word AS topic, place, w.text || ': ' || d.text AS reply, eff_mu, witnesses FROM defs d JOIN words w USING (word) WHERE place <= 3
UNION ALL SELECT topic, CAST(1001 AS INTEGER), '  → is ' || name, NULL, NULL FROM s1 JOIN names ON id = b UNION ALL SELECT topic, CAST(1002 AS INTEGER), '    → is ' || name, NULL, NULL FROM s2 JOIN names ON id = b"""))
def recall_what_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(recall.what_is(_definitions(spark, sf_dir, 3), recall.ladder(_rated(spark, sf_dir), _topics(spark, sf_dir), _t("IS_A")), _labels(spark, sf_dir)))


@query(_sql("""pairs AS (SELECT x.word AS source, md5('kind:' || k) AS target, x.text AS f, k AS t FROM words x, unnest(['thing', 'b']) z(k)),
ups AS (SELECT subject_id AS a, object_id AS b FROM links WHERE relation = 'IS_A'),
one AS (SELECT a, b FROM ups), two AS (SELECT x.a, y.b, x.b AS mid FROM ups x JOIN ups y ON y.a = x.b)
SELECT source, target, CASE WHEN one.a IS NOT NULL THEN 'Yes — ' || f || ' —IS_A→ ' || t WHEN two.a IS NOT NULL THEN 'Yes — ' || f || ' —IS_A→ ' || n.name || ' —IS_A→ ' || t ELSE 'No witnessed IS_A path from "' || f || '" to "' || t || '".' END AS reply
FROM pairs LEFT JOIN one ON one.a = source AND one.b = target LEFT JOIN two ON two.a = source AND two.b = target LEFT JOIN names n ON n.id = two.mid"""))
def recall_is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import converse

    targets = spark.createDataFrame([("kind:thing",), ("kind:b",)], "n string").select(ids.canonical_id("n").alias("target"))
    # every word is asked about two kinds
    pairs = words(spark, sf_dir).select(F.col("word").alias("source")).crossJoin(F.broadcast(targets))
    labels = _labels(spark, sf_dir)
    paths = graph.shortest_paths(_rated(spark, sf_dir), pairs, 4, _t("IS_A"), True)
    chains = converse.rendered_path(paths, labels, law(spark))
    return _hex(recall.is_a(paths, pairs, chains, labels))


@query(_sql("""pairs AS (SELECT DISTINCT md5('word:' || w1) AS a, md5('word:' || w2) AS b FROM p),
ways AS (SELECT subject_id AS a, object_id AS b, relation, mu, subject_id FROM links UNION ALL SELECT object_id, subject_id, relation, mu, subject_id FROM links),
best AS (SELECT a, b, relation, mu FROM ways JOIN pairs USING (a, b) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY mu DESC, md5(relation), subject_id) = 1),
near AS (SELECT DISTINCT subject_id AS id, object_id AS n FROM consensus UNION SELECT object_id, subject_id FROM consensus),
shared AS (SELECT a, b, count(*) AS n FROM pairs JOIN near x ON x.id = a JOIN near y ON y.id = b AND y.n = x.n GROUP BY ALL)
SELECT a, b, coalesce(relation, 'unrelated') AS relation, round(mu / 1e9, 3) AS eff_mu, coalesce(n, 0) AS witnesses FROM pairs LEFT JOIN best USING (a, b) LEFT JOIN shared USING (a, b)"""))
def recall_relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: ids.canonical_id(F.concat(F.lit("word:"), c))
    pairs = parts(spark, sf_dir).select(name("w1").alias("a"), name("w2").alias("b"))
    rows = recall.relation_summary(_rated(spark, sf_dir), pairs, law(spark))
    return _hex(rows.select("a", "b", F.substring_index("reply", "  [", 1).alias("relation"), "eff_mu", "witnesses"))


@query(_sql("""ids AS (SELECT p_partkey AS prompt_id, md5('word:' || w) AS id, w = w1 AS topic FROM pw)
SELECT prompt_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS context FROM ids WHERE (prompt_id, id) NOT IN (SELECT prompt_id, id FROM ids WHERE topic) GROUP BY prompt_id"""))
def recall_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    name = lambda c: ids.canonical_id(F.concat(F.lit("word:"), c))
    each = rows.select(F.col("p_partkey").alias("prompt_id"), F.explode(F.split("p_name", " ")).alias("w")).select("prompt_id", name("w").alias("id"))
    out = recall.context_exclude(each, rows.select(F.col("p_partkey").alias("prompt_id"), name("w1").alias("topic")))
    return out.select("prompt_id", F.concat_ws(",", F.transform("context", lambda x: F.lower(F.hex(x)))).alias("context"))


@query(_sql(f"""{_DEFS}, asked AS (SELECT row_number() OVER (ORDER BY text) AS prompt_id, word, text, CASE WHEN substr(text, 1, 1) < 'm' THEN 'define' ELSE 'related' END AS intent FROM words),
rel AS (SELECT subject_id AS topic, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY mu DESC, object_id) AS INTEGER) AS place, name AS reply FROM links JOIN names ON id = object_id WHERE relation = 'CAUSES'),
told AS (SELECT a.word AS topic, intent, place, d.text AS reply FROM asked a JOIN defs d USING (word) WHERE intent = 'define' AND place <= 5 UNION ALL SELECT word, intent, place, reply FROM asked JOIN rel ON topic = word WHERE intent = 'related' AND place <= 24)
FROM told UNION ALL SELECT word, intent, place, a.text || ': ' || d.text FROM asked a JOIN defs d USING (word) WHERE place <= 3 AND word NOT IN (SELECT topic FROM told)"""))
def recall_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word asked for what its first letter says: definitions up to l, else what it causes; the gloss if that is nothing."""
    w = words(spark, sf_dir)
    asked = w.select(F.col("text").alias("prompt_id"), F.when(F.substring("text", 1, 1) < "m", "define").otherwise("related").alias("intent"), F.col("word").alias("topic"))
    labels = _labels(spark, sf_dir)
    topics = w.select(F.col("word").alias("topic"))
    responses = {"define": recall.gloss(_definitions(spark, sf_dir)), "related": recall.related(_rated(spark, sf_dir), topics, labels, type_id("CAUSES")), "fallback": recall.labelled_gloss(_definitions(spark, sf_dir, 3), labels)}
    return _hex(recall.respond(asked, responses).select("topic", "intent", F.col("place").cast("int").alias("place"), "reply"))


@query(_sql("""r AS (SELECT subject_id AS topic, CASE relation WHEN 'HAS_DEFINITION' THEN 1 WHEN 'IS_A' THEN 2 WHEN 'IS_SYNONYM_OF' THEN 3 WHEN 'HAS_SENSE' THEN 3 ELSE 99 END AS tier, relation, object_id, eff_mu, witnesses, rank, mu FROM links WHERE subject_id IN (SELECT word FROM words)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY tier, round(rank * mu / 1e9, 9) DESC, object_id, md5(relation)) AS INTEGER) AS place FROM r) SELECT topic, place, tier, relation, object_id, eff_mu, witnesses FROM n WHERE place <= 12"""))
def converse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recall.facts(_rated(spark, sf_dir), _topics(spark, sf_dir), {"definitional": 1, "taxonomic": 2, "equivalence": 3}, 12)
    return _hex(rows.withColumn("place", F.col("place").cast("int")))
