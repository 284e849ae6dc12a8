"""Counts, existence probes, health reports and relation masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import edge_rank, eff_mu, refuted, verdict

#: Words of a relation mask and the bits of each.
MASK_WORDS, MASK_BITS = 4, 64


# --- probes -------------------------------------------------------------------------------------------------------


def present_ordinals(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The ordinals (idx) of wanted rows whose keys are stored."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_semi").select("idx")


def bitmap(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """word, bits: bit i % 64 of word i / 64 is set if wanted row i is stored; words without a set bit are there too."""
    stored_keys = stored.select(*keys, F.lit(True).alias("_there")).distinct()
    bit = F.when(F.col("_there"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    return wanted.join(stored_keys, keys, "left").groupBy(F.floor(F.col("idx") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def descent(wanted: DataFrame, stored: DataFrame, depth: int = 5) -> DataFrame:
    """idx of wanted rows (idx, id, parent) that are stored or below one that is; parent is another row's idx or null."""
    from .model import cut

    found = cut(wanted.join(stored.select("id").distinct(), "id", "left_semi").select("idx"), "descent")
    level = found
    for _ in range(depth):
        below = wanted.join(level.select(F.col("idx").alias("parent")), "parent", "left_semi").select("idx").join(found, "idx", "left_anti")
        level = cut(below, "descent")
        if level.isEmpty():
            break
        found = found.union(level)
    return found


# --- counts -------------------------------------------------------------------------------------------------------


def arena_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type_id", "relation").agg(F.count("*").alias("relations"), F.sum("witness_count").alias("witnesses"), F.max(eff_mu()).alias("top_eff_mu"))


def band_leaders(edges: DataFrame, bands: list[str], per: int = 5) -> DataFrame:
    rows = edges.filter(F.col("band").isin(*bands) & ~refuted())
    place = F.row_number().over(Window.partitionBy("band").orderBy(edge_rank().desc(), "subject_id", "type_id", "object_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= per)


def entity_record(consensus: DataFrame) -> DataFrame:
    """For each subject how many of its cells have each verdict."""
    v = verdict()
    return consensus.groupBy("subject_id").agg(*[F.count_if(v == k).alias(k) for k in ("confirmed", "contested", "refuted", "thin")])


def evidence_count(evidence: DataFrame, type_id: bytes | None = None, source_id: bytes | None = None, object_id: bytes | None = None) -> DataFrame:
    for column, value in (("type_id", type_id), ("source_id", source_id), ("object_id", object_id)):
        evidence = evidence if value is None else evidence.filter(F.col(column) == F.lit(value))
    return evidence.agg(F.count("*").alias("n"))


def counts_by_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Entities of each type (type_id) asked for; 0 where there are none."""
    own = entities.groupBy("type_id").agg(F.count("*").alias("entities"))
    return types.select("type_id").distinct().join(own, "type_id", "left").fillna(0, ["entities"])


def multi_source_entities(evidence: DataFrame) -> DataFrame:
    rows = evidence.select("subject_id", "source_id").distinct().groupBy("subject_id").count().filter("count > 1")
    return rows.agg(F.count("*").alias("n"))


def source_counts(evidence: DataFrame, content: DataFrame) -> DataFrame:
    """Evidence and distinct content (entity_id, source_id) of every source that has either."""
    e = evidence.groupBy("source_id").agg(F.count("*").alias("evidence"))
    c = content.select("source_id", "entity_id").distinct().groupBy("source_id").agg(F.count("*").alias("content"))
    return e.join(c, "source_id", "full_outer").fillna(0, ["evidence", "content"])


def source_roster(evidence: DataFrame, source_id: bytes, limit: int = 40) -> DataFrame:
    rows = evidence.filter(F.col("source_id") == F.lit(source_id))
    return rows.orderBy(F.desc("observation_count"), "subject_id", "type_id", "object_id", "context_id").limit(limit)


def tier_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("tier").agg(F.count("*").alias("n"))


def identity_violations(entities: DataFrame, trajectories: DataFrame) -> DataFrame:
    """id, tier, reason: tiers out of range, ids that are there several times, keys (entity_id, phys_type, id) with several
    trajectories, and types that are no entity, each once. trajectories: with points, and id where a key has one."""
    nothing = F.lit(None).cast("short")
    out = entities.filter("tier < 0 or tier >= 256").select("id", "tier", F.lit("tier_out_of_range").alias("reason"))
    several = entities.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    twice = entities.join(several, "id", "left_semi").select("id", "tier", F.lit("multi_tier_entity").alias("reason"))
    key = [c for c in ("entity_id", "phys_type", "id") if c in trajectories.columns]
    unclear = trajectories.filter("points is not null").groupBy(*key).agg(F.countDistinct("points").alias("n")).filter("n > 1")
    unclear = unclear.select(F.col("entity_id").alias("id"), nothing.alias("tier"), F.lit("ambiguous_physicality").alias("reason"))
    types = entities.filter("type_id is not null").select("type_id").distinct()
    dangling = types.join(entities.select(F.col("id").alias("type_id")), "type_id", "left_anti").select(F.col("type_id").alias("id"), nothing.alias("tier"), F.lit("dangling_entity_type").alias("reason"))
    return out.unionByName(twice).unionByName(unclear).unionByName(dangling)


def orphans(trajectories: DataFrame, entities: DataFrame) -> DataFrame:
    return trajectories.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_anti").agg(F.count("*").alias("n"))


def partition_pressure(table: DataFrame, key: str) -> DataFrame:
    """Rows of each value of a partition column, and their share."""
    each = table.groupBy(key).agg(F.count("*").alias("rows"))
    return each.crossJoin(F.broadcast(table.agg(F.count("*").alias("_all")))).select(key, "rows", (F.col("rows") / F.col("_all")).alias("share"))


def pair_plane_score(consensus: DataFrame, pairs: DataFrame, type_id: bytes) -> DataFrame:
    """pairs (a, b) with the better rating of both directions under a relation, 0 at least."""
    own = consensus.filter(F.col("type_id") == F.lit(type_id)).select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), (eff_mu() / F.lit(1e9)).alias("mu"))
    both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "mu")).groupBy("a", "b").agg(F.max("mu").alias("mu"))
    return pairs.join(both, ["a", "b"], "left").withColumn("score", F.greatest(F.coalesce("mu", F.lit(0.0)), F.lit(0.0))).drop("mu")


# --- masks --------------------------------------------------------------------------------------------------------


def mask_of(bit: str | Column) -> Column:
    """The mask with one bit: four words of 64."""
    b = F.col(bit) if isinstance(bit, str) else bit
    return F.array(*[F.when(F.floor(b / MASK_BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (b % MASK_BITS).cast("int"))).otherwise(F.lit(0).cast("long")) for w in range(MASK_WORDS)])


def mask_or(mask: str = "mask") -> Column:
    """An aggregate: the union of masks."""
    return F.array(*[F.bit_or(F.col(mask)[w]) for w in range(MASK_WORDS)])


def mask_match(a: str, b: str | Column) -> Column:
    other = F.col(b) if isinstance(b, str) else b
    return F.exists(F.arrays_zip(F.col(a).alias("a"), other.alias("b")), lambda x: x["a"].bitwiseAND(x["b"]) != 0)


def mask_popcount(mask: str = "mask") -> Column:
    return F.aggregate(F.transform(mask, lambda w: F.bit_count(w)), F.lit(0), lambda acc, n: acc + n)


def mask_bits(mask: str = "mask") -> Column:
    """The positions of a mask's set bits."""
    bits = [F.when(F.col(mask)[w].bitwiseAND(F.shiftleft(F.lit(1).cast("long"), k)) != 0, w * MASK_BITS + k) for w in range(MASK_WORDS) for k in range(MASK_BITS)]
    return F.filter(F.array(*bits), lambda x: x.isNotNull())


def entity_masks(edges: DataFrame) -> DataFrame:
    """For every entity the mask of the relations it takes part in, on either side. edges: with bit."""
    own = edges.filter("bit is not null")
    ends = own.select(F.col("subject_id").alias("id"), "bit").union(own.filter("object_id is not null").select("object_id", "bit")).distinct()
    return ends.withColumn("mask", mask_of("bit")).groupBy("id").agg(mask_or().alias("mask"))


def deposit_masks(masks: DataFrame, more: DataFrame) -> DataFrame:
    """masks with more (id, bit) set."""
    return masks.unionByName(more.select("id", mask_of("bit").alias("mask"))).groupBy("id").agg(mask_or().alias("mask"))


def refresh_masks(masks: DataFrame, edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """masks with those of the dirty ids (id) computed anew from the edges; an id without edges loses its mask."""
    d = dirty.select("id").distinct()
    touched = edges.join(d.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").unionByName(edges.join(d.withColumnRenamed("id", "object_id"), "object_id", "left_semi"))
    return masks.join(d, "id", "left_anti").unionByName(entity_masks(touched).join(d, "id", "left_semi"))
