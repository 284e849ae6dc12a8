"""Text from compositions: constituents in order, and whole texts put together level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rating import eff_mu, refuted
from . import graph
from .model import cut


def constituents(trajectories: DataFrame) -> DataFrame:
    """The rows of each composition: entity_id, ordinal, child, run, ctier; ordinal counts runs as often as they repeat."""
    p = trajectories.select("entity_id", F.posexplode("points").alias("at", "p"))
    return p.select("entity_id", F.col("p.ordinal").alias("ordinal"), F.col("p.child").alias("child"), F.col("p.run").alias("run"), F.col("p.ctier").alias("ctier"))


def constituents_closure(links: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """All links (parent, ordinal, child, run) below each root (id), whether or not they go round in circles."""
    below = graph.closure(links.select("parent", "child").distinct(), roots, max_depth).select(F.col("at").alias("parent")).distinct()
    return links.join(below, "parent", "left_semi")


def render_text(links: DataFrame, atoms: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """id, text of each root: atoms (id, text) put together in the order of links (parent, ordinal, child, run).

    Each round renders what has all its parts; a composition in a circle, or with a part that nothing renders, stays null.
    """
    own = cut(constituents_closure(links, roots, max_depth), "render-links")
    sizes = own.groupBy("parent").agg(F.count("*").alias("n"))
    known = cut(atoms.select("id", "text").join(own.select(F.col("child").alias("id")).union(roots.select("id")).distinct(), "id", "left_semi"), "render-text")
    for _ in range(max_depth):
        open_ = own.join(known.select(F.col("id").alias("parent")), "parent", "left_anti")
        parts = open_.join(known.select(F.col("id").alias("child"), "text"), "child")
        piece = F.struct("ordinal", F.expr("repeat(text, greatest(run, 1))").alias("t"))
        whole = parts.groupBy("parent").agg(F.count("*").alias("have"), F.sort_array(F.collect_list(piece)).alias("pieces")).join(sizes, "parent").filter("have = n")
        new = cut(whole.select(F.col("parent").alias("id"), F.concat_ws("", F.transform("pieces", lambda s: s["t"])).alias("text")), "render-text")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return roots.select("id").distinct().join(known, "id", "left")


def render_gaps(links: DataFrame, rendered: DataFrame, limit: int = 50) -> DataFrame:
    """Parts that nothing renders, those most often referred to first: id, refs."""
    missing = links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("refs")).join(rendered.filter("text is not null").select("id"), "id", "left_anti")
    return missing.orderBy(F.desc("refs"), "id").limit(limit)


# --- names of ids -------------------------------------------------------------------------------------------------


def canonical(names: DataFrame) -> DataFrame:
    """id, text of names like substrate/<kind>/<name>/v1: the name inside."""
    own = names.filter(F.col("name").startswith("substrate/"))
    return own.select("id", F.regexp_replace("name", "^substrate/[a-z_]+/(.+)/v1$", "$1").alias("text"))


def _first_text(rows: DataFrame, texts: DataFrame, tongue: DataFrame | None) -> DataFrame:
    """Of rows (id, cand, preferred, mu) each id's first candidate that has a text: those of the language (tongue: id)
    first, then preferred ones, then by rating."""
    known = rows.join(texts.filter("text <> ''").select(F.col("id").alias("cand"), "text"), "cand")
    if tongue is None:
        known = known.withColumn("spoken", F.lit(False))
    else:
        known = known.join(tongue.select(F.col("id").alias("cand"), F.lit(True).alias("spoken")).distinct(), "cand", "left").withColumn("spoken", F.coalesce("spoken", F.lit(False)))
    order = F.struct(~F.col("spoken"), ~F.col("preferred"), -F.col("mu"), F.col("cand"))
    return known.groupBy("id").agg(F.min_by("text", order).alias("text"))


def _edges(consensus: DataFrame, types: list[bytes]) -> DataFrame:
    return consensus.filter(F.col("type_id").isin(*types) & ~refuted() & F.col("object_id").isNotNull())


def speakers(consensus: DataFrame, language: bytes, lang: bytes) -> DataFrame:
    """Ids that have the language lang under the relation language."""
    return consensus.filter((F.col("type_id") == F.lit(language)) & (F.col("object_id") == F.lit(lang))).select(F.col("subject_id").alias("id"))


def has_name(consensus: DataFrame, texts: DataFrame, name: bytes, alias: bytes, tongue: DataFrame | None = None) -> DataFrame:
    """id, text: the best name; an alias only where there is no name, a name of the language before all."""
    rows = _edges(consensus, [name, alias])
    return _first_text(rows.select(F.col("subject_id").alias("id"), F.col("object_id").alias("cand"), (F.col("type_id") == F.lit(name)).alias("preferred"), eff_mu().alias("mu")), texts, tongue)


def synset_lemma(consensus: DataFrame, texts: DataFrame, sense: bytes, synset: bytes, tongue: DataFrame | None = None) -> DataFrame:
    """id, text: the best word with a sense of the synset."""
    up = _edges(consensus, [synset]).select(F.col("subject_id").alias("sense_id"), F.col("object_id").alias("id"))
    words = consensus.filter(F.col("type_id") == F.lit(sense)).select(F.col("object_id").alias("sense_id"), F.col("subject_id").alias("cand"), eff_mu().alias("mu"))
    return _first_text(up.join(words, "sense_id").select("id", "cand", F.lit(True).alias("preferred"), "mu"), texts, tongue)


def translation(consensus: DataFrame, texts: DataFrame, translates: bytes, tongue: DataFrame | None = None) -> DataFrame:
    """id, text: the best translation."""
    rows = _edges(consensus, [translates])
    return _first_text(rows.select(F.col("subject_id").alias("id"), F.col("object_id").alias("cand"), F.lit(True).alias("preferred"), eff_mu().alias("mu")), texts, tongue)


def defines(consensus: DataFrame, texts: DataFrame, definition: bytes) -> DataFrame:
    """id, text: the best definition's text, null if that has none."""
    best = _edges(consensus, [definition]).groupBy(F.col("subject_id").alias("id")).agg(F.min_by("object_id", F.struct(-eff_mu(), "object_id")).alias("cand"))
    return best.join(texts.select(F.col("id").alias("cand"), "text"), "cand", "left").select("id", "text")


def coalesced(ids: DataFrame, *steps: DataFrame) -> DataFrame:
    """id, text of each id by the first step (id, text) that has one that isn't empty; each step has an id at most once."""
    out = ids.select("id").distinct().withColumn("text", F.lit(None).cast("string"))
    for step in steps:
        out = out.join(step.filter("text <> ''").select("id", F.col("text").alias("_next")), "id", "left").select("id", F.coalesce("text", "_next").alias("text"))
    return out


def resolve_name(ids: DataFrame, consensus: DataFrame, texts: DataFrame, name: bytes, alias: bytes, sense: bytes, synset: bytes, tongue: DataFrame | None = None) -> DataFrame:
    """id, text: a name, else a word of the synset."""
    return coalesced(ids, has_name(consensus, texts, name, alias, tongue), synset_lemma(consensus, texts, sense, synset, tongue))


def realize(ids: DataFrame, consensus: DataFrame, texts: DataFrame, names: DataFrame, roles: dict[str, bytes], tongue: DataFrame | None = None) -> DataFrame:
    """id, text by the ladder: own text, resolved name, translation, canonical name, definition.

    roles: name, alias, sense, synset, translation, definition. A label falls back to the id's digits; see lexical.labels.
    """
    named = resolve_name(ids, consensus, texts, roles["name"], roles["alias"], roles["sense"], roles["synset"], tongue)
    return coalesced(ids, texts, named, translation(consensus, texts, roles["translation"], tongue), canonical(names), defines(consensus, texts, roles["definition"]))


def whitespace_only(text: str = "text"):
    """Whether a text is nothing but white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]", "") == ""


def vertex_atom(flags: str = "flags"):
    return F.shiftright(F.col(flags).cast("long"), 31).bitwiseAND(0x1FFFFF).cast("int")


def vertex_tier(flags: str = "flags"):
    return F.shiftright(F.col(flags).cast("long"), 1).bitwiseAND(31).cast("short")


def register_canonicals(names: DataFrame, more: DataFrame) -> DataFrame:
    """names (id, name) with those of more (name) that aren't there yet."""
    from ..functions.ids import canonical_id

    new = more.select("name").filter("name is not null").distinct().select(canonical_id("name").alias("id"), "name")
    return names.unionByName(new.join(names.select("id"), "id", "left_anti"))


def render_trace(links: DataFrame, rendered: DataFrame, roots: DataFrame, max_depth: int = 32) -> DataFrame:
    """Why parts below each root don't render: parent, ordinal, child, verdict (ok, missing, or empty: a part without text)."""
    own = constituents_closure(links, roots, max_depth)
    known = rendered.select(F.col("id").alias("child"), "text", F.lit(True).alias("there"))
    verdict = F.when(F.col("text") != "", "ok").when(F.col("there") & (F.col("text") == ""), "empty").otherwise("missing")
    return own.join(known, "child", "left").select("parent", "ordinal", "child", verdict.alias("verdict"))
