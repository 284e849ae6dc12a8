"""Readers of knowledge sources: each turns files into rows of (subject, relation, object, weight) or of tokens.

All read through Spark, so paths may be globs in any store, and every file is split where its format allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = ("subject", "relation", "object", "weight")


def concept_assertions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated assertions: uri, relation, start, end, and JSON with a weight; nodes as /c/<language>/<term>/..."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="uri string, rel string, a string, b string, info string")
    node = lambda c: F.concat_ws(":", F.element_at(F.split(c, "/"), 3), F.element_at(F.split(c, "/"), 4))
    weight = F.coalesce(F.get_json_object("info", "$.weight").cast("double"), F.lit(1.0))
    return rows.filter("a is not null and b is not null").select(node("a").alias("subject"), F.element_at(F.split("rel", "/"), -1).alias("relation"), node("b").alias("object"), weight.alias("weight"))


def triples_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated head, relation, tail; tails of 'none' say nothing."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="subject string, relation string, object string")
    return rows.filter("object is not null and lower(trim(object)) <> 'none'").select(F.trim("subject").alias("subject"), F.trim("relation").alias("relation"), F.trim("object").alias("object"), F.lit(1.0).alias("weight"))


def language_codes(spark: SparkSession, path: str) -> DataFrame:
    """A table of language codes with a header: one row a code (id, name, two-letter code, scope, type)."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.select(F.col("Id").alias("id"), F.col("Ref_Name").alias("name"), F.nullif(F.col("Part1"), F.lit("")).alias("code2"), F.col("Scope").alias("scope"), F.col("Language_Type").alias("kind"))


def wordnet_tab(spark: SparkSession, path: str) -> DataFrame:
    """Tab files of synset, <language>:lemma, word; comment lines begin with #."""
    rows = spark.read.csv(path, sep="\t", quote="", comment="#", schema="synset string, kind string, value string")
    parts = F.split("kind", ":")
    return rows.filter("value is not null").select(F.col("value").alias("subject"), F.when(F.element_at(parts, -1) == "lemma", "IN_SYNSET").otherwise(F.upper(F.element_at(parts, -1))).alias("relation"), F.col("synset").alias("object"), F.when(F.size(parts) > 1, parts[0]).alias("lang"), F.lit(1.0).alias("weight"))


def sentence_links(spark: SparkSession, sentences: str, links: str) -> DataFrame:
    """Pairs of sentences (id, language, text) that links (id, id) call translations."""
    s = spark.read.csv(sentences, sep="\t", quote="", schema="id long, lang string, text string")
    pairs = spark.read.csv(links, sep="\t", schema="a long, b long")
    left = s.select(F.col("id").alias("a"), F.col("lang").alias("lang_a"), F.col("text").alias("subject"))
    right = s.select(F.col("id").alias("b"), F.col("lang").alias("lang_b"), F.col("text").alias("object"))
    return pairs.join(left, "a").join(right, "b").select("subject", F.lit("TRANSLATES").alias("relation"), "object", F.lit(1.0).alias("weight"), "lang_a", "lang_b")


def dictionary_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON entry a line (word, lang_code, pos, senses[glosses], synonyms[word], ...) to triples."""
    name = "array<struct<word:string>>"
    schema = f"word string, lang_code string, pos string, senses array<struct<glosses:array<string>,synonyms:{name}>>, synonyms {name}, antonyms {name}, hypernyms {name}, translations array<struct<word:string,code:string>>"
    rows = spark.read.schema(schema).json(path)
    word = F.concat_ws(":", "lang_code", "word").alias("subject")
    out = rows.select(word, F.lit("HAS_POS").alias("relation"), F.col("pos").alias("object"))
    out = out.unionByName(rows.select(word, F.lit("HAS_GLOSS").alias("relation"), F.explode(F.flatten(F.transform("senses", lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>"))))).alias("object")))
    for column, relation in (("synonyms", "SYNONYM"), ("antonyms", "ANTONYM"), ("hypernyms", "IS_A")):
        out = out.unionByName(rows.select(word, F.lit(relation).alias("relation"), F.col("lang_code"), F.explode(f"{column}.word").alias("w")).select("subject", "relation", F.concat_ws(":", "lang_code", "w").alias("object")))
    t = rows.select(word, F.explode("translations").alias("t"))
    out = out.unionByName(t.select("subject", F.lit("TRANSLATES").alias("relation"), F.concat_ws(":", "t.code", "t.word").alias("object")))
    return out.filter("object is not null").withColumn("weight", F.lit(1.0))


_CONLLU = "sent string, id int, form string, lemma string, upos string, feats string, head int, deprel string"


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of CoNLL-U files. A record is one sentence, so files are split between sentences."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block in batch["value"]:
                name = None
                for line in block.split("\n"):
                    if line.startswith("# sent_id"):
                        name = line.partition("=")[2].strip()
                    f = line.split("\t")
                    if len(f) == 10 and f[0].isdigit():
                        out.append((name, int(f[0]), f[1], f[2], f[3], None if f[5] == "_" else f[5], int(f[6]) if f[6].isdigit() else None, f[7]))
            yield pd.DataFrame(out, columns=["sent", "id", "form", "lemma", "upos", "feats", "head", "deprel"]).astype({"head": "Int32"})

    return blocks.mapInPandas(parse, _CONLLU)


_TAG = re.compile(r'\[(\w+)\s+"([^"]*)"\]')
_MOVE = re.compile(r"\{[^}]*\}|;[^\n]*|\([^()]*\)|\$\d+|\d+\.+|1-0|0-1|1/2-1/2|\*")


def pgn(spark: SparkSession, path: str) -> DataFrame:
    """Chess games: tags and moves in short notation; records are split before each [Event tag."""
    games = spark.read.option("lineSep", "[Event ").text(path).filter("trim(value) <> ''")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["value"]:
                text = "[Event " + text
                tags = dict(_TAG.findall(text))
                moves = _MOVE.sub(" ", text.rpartition("]")[2]).split()
                out.append((tags.get("Event"), tags.get("White"), tags.get("Black"), tags.get("Result"), tags.get("ECO"), moves))
            yield pd.DataFrame(out, columns=["event", "white", "black", "result", "eco", "moves"])

    return games.mapInPandas(parse, "event string, white string, black string, result string, eco string, moves array<string>")


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of XML files as rows of a schema; attributes are columns with a leading underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def mapping_text(spark: SparkSession, path: str, separator: str = r"\s+", relation: str = "CORRESPONDS_TO") -> DataFrame:
    """Lines of two names that correspond; lines that begin with # are comments."""
    parts = F.split(F.trim("value"), separator, 2)
    rows = spark.read.text(path).filter("trim(value) <> '' and not value like '#%'")
    return rows.select(parts[0].alias("subject"), F.lit(relation).alias("relation"), parts[1].alias("object"), F.lit(1.0).alias("weight")).filter("object is not null")


def turtle_pairs(spark: SparkSession, path: str, predicate: str, relation: str) -> DataFrame:
    """Subject and object of one predicate in Turtle files that have a triple on a line."""
    pattern = rf"^\s*(\S+)\s+{predicate}\s+(\S+?)\s*[.;]"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("subject"), F.lit(relation).alias("relation"), F.regexp_extract("value", pattern, 2).alias("object"), F.lit(1.0).alias("weight"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def tabular(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with a header as triples: the key's value, the column's name, the value."""
    rows = spark.read.csv(path, header=True)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(f"`{c}`").alias("object")) for c in rows.columns if c != key]))
    return rows.select(F.col(f"`{key}`").alias("subject"), pairs.alias("p")).select("subject", "p.relation", "p.object", F.lit(1.0).alias("weight")).filter("object is not null")


def parquet_triples(spark: SparkSession, path: str, subject: str, relation: str, obj: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(subject).cast("string").alias("subject"), F.lit(relation).alias("relation"), F.col(obj).cast("string").alias("object"), F.lit(1.0).alias("weight"))
