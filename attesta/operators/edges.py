"""Ranked reads of the rated edges. Batches of subjects are DataFrames, so one subject and millions are one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import belief_logit, edge_rank, eff_mu, eff_mu_display, refuted, verdict, walk_edge_weight


def ranked(consensus: DataFrame, law: DataFrame) -> DataFrame:
    """consensus with relation, band and rank; a relation that the law doesn't have ranks 0.

    The law has a row for each relation (a few hundred), which bounds what is sent to every task.
    """
    return consensus.join(F.broadcast(law.select("type_id", "relation", "band", "rank", "bit")), "type_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))


def _top(rows: DataFrame, keys: list[str], limit: int | None, *order: Column) -> DataFrame:
    """The first rows of each key; without keys, of all."""
    if limit is None:
        return rows
    if not keys:
        return rows.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def edges_raw(edges: DataFrame, subjects: DataFrame, direction: str = "both", types: list[bytes] | None = None, limit: int | None = 40, include_refuted: bool = False, rank: str = "edge_rank") -> DataFrame:
    """Each subject's (subject_id) edges out of it, into it or both, the best first. edges: ranked().

    An edge from a subject to itself is given once, as outgoing, unless only incoming ones are asked for.
    """
    arms = []
    own = edges if types is None else edges.filter(F.col("type_id").isin(*types))
    own = own if include_refuted else own.filter(~refuted())
    wanted = subjects.select(F.col("subject_id").alias("root")).distinct()
    state = ["type_id", "relation", "rank", "rating", "rd", "volatility", "witness_count"]
    if direction in ("out", "both"):
        out = own.filter("object_id is not null").join(wanted, F.col("subject_id") == F.col("root"))
        arms.append(out.select("root", F.lit("out").alias("direction"), F.col("object_id").alias("neighbour_id"), *state))
    if direction in ("in", "both"):
        into = own.join(wanted, F.col("object_id") == F.col("root"))
        into = into if direction == "in" else into.filter("subject_id <> root")
        arms.append(into.select("root", F.lit("in").alias("direction"), F.col("subject_id").alias("neighbour_id"), *state))
    rows = arms[0].unionByName(arms[1]) if len(arms) > 1 else arms[0]
    by = edge_rank() if rank == "edge_rank" else eff_mu() / F.lit(1e9)
    return _top(rows, ["root"], limit, by.desc(), F.col("neighbour_id"), F.col("type_id"), F.when(F.col("direction") == "out", 0).otherwise(1))


def consensus_out(consensus: DataFrame, subjects: DataFrame, limit: int = 40) -> DataFrame:
    rows = consensus.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return _top(rows, ["subject_id"], limit, eff_mu().desc(), F.col("object_id"), F.col("type_id"))


def consensus_in(consensus: DataFrame, objects: DataFrame, limit: int = 40) -> DataFrame:
    rows = consensus.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    return _top(rows, ["object_id"], limit, eff_mu().desc(), F.col("subject_id"), F.col("type_id"))


def completions(edges: DataFrame, subjects: DataFrame, limit: int = 40) -> DataFrame:
    """Outgoing edges by rank of the relation times conservative rating."""
    return edges_raw(edges, subjects, "out", limit=limit).withColumns({"eff_mu": eff_mu_display(), "witnesses": F.col("witness_count")})


def neighbors(edges: DataFrame, subjects: DataFrame, types: list[bytes] | None, limit: int, directed: bool = True) -> DataFrame:
    return edges_raw(edges, subjects, "out" if directed else "both", types, limit, rank="eff_mu")


def top_relations(edges: DataFrame, limit: int = 50, types: list[bytes] | None = None) -> DataFrame:
    """The strongest edges of all that aren't refuted."""
    rows = edges.filter(~refuted() & F.col("object_id").isNotNull())
    rows = rows if types is None else rows.filter(F.col("type_id").isin(*types))
    return rows.orderBy(edge_rank().desc(), "subject_id", "type_id", "object_id").limit(limit)


def belief_distribution(consensus: DataFrame, subjects: DataFrame, types: list[bytes], k: int = 20) -> DataFrame:
    """For each subject and relation a softmax over its objects' belief logits, the k likeliest."""
    rows = consensus.filter(F.col("type_id").isin(*types) & F.col("object_id").isNotNull()).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    by = Window.partitionBy("subject_id", "type_id")
    rows = rows.withColumn("logit", belief_logit()).withColumn("e", F.exp(F.col("logit") - F.max("logit").over(by)))
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(by)).drop("e")
    return _top(rows, ["subject_id", "type_id"], k, eff_mu().desc(), F.col("object_id"))


def classify_circuit(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best relation between each pair (subject_id, object_id)."""
    rows = edges.join(pairs.select("subject_id", "object_id").distinct(), ["subject_id", "object_id"], "left_semi")
    return _top(rows, ["subject_id", "object_id"], 1, eff_mu().desc(), F.col("type_id"))


def by_ids(consensus: DataFrame, wanted: DataFrame) -> DataFrame:
    return consensus.join(wanted.select("id").distinct(), "id", "left_semi")


def cell(consensus: DataFrame, keys: DataFrame) -> DataFrame:
    """The state of each triple (subject_id, type_id, object_id; the object may be null)."""
    k = keys.select("subject_id", "type_id", F.col("object_id").alias("_object")).distinct()
    return consensus.join(k, ["subject_id", "type_id"]).filter(F.col("object_id").eqNullSafe(F.col("_object"))).drop("_object")


def pair_scores(consensus: DataFrame, pairs: DataFrame, type_id: bytes) -> DataFrame:
    """pairs (ord, subject_id, object_id) with the conservative rating under one relation, 0 where there is none."""
    own = consensus.filter(F.col("type_id") == F.lit(type_id)).select("subject_id", "object_id", (eff_mu() / F.lit(1e9)).alias("score"))
    return pairs.join(own, ["subject_id", "object_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def shared_objects(consensus: DataFrame, subjects: DataFrame, types: list[bytes] | None = None, limit: int | None = 40) -> DataFrame:
    """Objects that many of the subjects have: how many, and the sum of the best rating of each."""
    rows = consensus.filter(~refuted() & F.col("object_id").isNotNull()).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    rows = rows if types is None else rows.filter(F.col("type_id").isin(*types))
    best = rows.groupBy("object_id", "subject_id").agg(F.max(eff_mu()).alias("mu"))
    out = best.groupBy("object_id").agg(F.count("*").cast("int").alias("support"), F.sum("mu").alias("total_mu"))
    return _top(out, [], limit, F.desc("support"), F.desc("total_mu"), F.col("object_id"))


def subjects_of_type(consensus: DataFrame, type_id: bytes) -> DataFrame:
    return consensus.filter(F.col("type_id") == F.lit(type_id)).select("subject_id").distinct()


def usage_overlap(consensus: DataFrame, x: bytes, y: bytes) -> DataFrame:
    """How many neighbours two ids share, whatever the direction."""

    def near(v: bytes) -> DataFrame:
        out = consensus.filter(F.col("subject_id") == F.lit(v)).select(F.col("object_id").alias("n"))
        return out.union(consensus.filter(F.col("object_id") == F.lit(v)).select("subject_id")).filter("n is not null").distinct()

    return near(x).join(near(y), "n", "left_semi").agg(F.count("*").alias("shared"))


def step_edge(consensus: DataFrame, pairs: DataFrame) -> DataFrame:
    """The strongest edge between each pair (a, b) in either direction."""
    one = pairs.select("a", "b", F.col("a").alias("subject_id"), F.col("b").alias("object_id"))
    other = pairs.select("a", "b", F.col("b").alias("subject_id"), F.col("a").alias("object_id"))
    rows = consensus.join(one.union(other), ["subject_id", "object_id"]).filter(~refuted())
    return _top(rows, ["a", "b"], 1, eff_mu().desc(), F.col("type_id"), F.col("subject_id"))


def band_edges(edges: DataFrame, band: str, min_eff_mu: int | None = None, limit: int = 1000) -> DataFrame:
    rows = edges.filter((F.col("band") == band) & ~refuted())
    rows = rows if min_eff_mu is None else rows.filter(eff_mu() >= min_eff_mu)
    return rows.orderBy(eff_mu().desc(), "subject_id", "type_id", "object_id").limit(limit)


def epistemic_status(consensus: DataFrame) -> DataFrame:
    return consensus.withColumn("verdict", verdict())


def distill(edges: DataFrame, bands: list[str], min_eff_mu: float) -> DataFrame:
    return edges.filter(F.col("band").isin(*bands) & (eff_mu() / F.lit(1e9) >= min_eff_mu)).withColumn("eff_mu", eff_mu() / F.lit(1e9))


def stats(evidence: DataFrame, consensus: DataFrame) -> DataFrame:
    """One row: sizes of both tables, rows of evidence for each cell, mean and largest number of witnesses."""
    e = evidence.agg(F.count("*").alias("evidence_rows"))
    c = consensus.agg(F.count("*").alias("consensus_rows"), F.avg("witness_count").alias("avg_witnesses"), F.max("witness_count").alias("max_witnesses"))
    return e.crossJoin(c).withColumn("dedup_ratio", F.col("evidence_rows") / F.col("consensus_rows"))


def entity_attestations(consensus: DataFrame, subjects: DataFrame, floor: int = 0) -> DataFrame:
    rows = consensus.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return rows.filter(eff_mu() >= floor)


def salient_facts(edges: DataFrame, subjects: DataFrame, structural: list[bytes], limit: int = 24) -> DataFrame:
    """Each subject's best facts of relations that say something about it."""
    return edges_raw(edges.filter(~F.col("type_id").isin(*structural)), subjects, "out", limit=limit)


def gaps(consensus: DataFrame, subjects: DataFrame, expected: DataFrame) -> DataFrame:
    """Relations (type_id) that each subject should have and has not."""
    return subjects.select("subject_id").distinct().crossJoin(F.broadcast(expected.select("type_id").distinct())).join(consensus, ["subject_id", "type_id"], "left_anti")


def subjects_with(consensus: DataFrame, type_id: bytes, members: list[bytes], limit: int = 100) -> DataFrame:
    """Subjects whose objects under a relation hold every member."""
    rows = consensus.filter((F.col("type_id") == F.lit(type_id)) & F.col("object_id").isin(*members))
    out = rows.groupBy("subject_id").agg(F.countDistinct("object_id").alias("n"), F.min(eff_mu()).alias("mu")).filter(F.col("n") == len(set(members)))
    return out.orderBy(F.desc("mu"), "subject_id").limit(limit)


def vocab_plane(edges: DataFrame, vocab: DataFrame, cap: int = 64, rank_lo: float = 0.0, rank_hi: float = 1.0, by_type: bool = False) -> DataFrame:
    """The edges within a vocabulary (id), weighted by rank times signed weight, each subject's heaviest."""
    ids = vocab.select("id").distinct()
    own = edges.filter(F.col("rank").between(rank_lo, rank_hi)).join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    keys = ["subject_id", "object_id", *(["type_id"] if by_type else [])]
    w = own.groupBy(*keys).agg(F.sum(F.col("rank") * walk_edge_weight()).alias("w"), F.max("rank").alias("layer_rank"))
    return _top(w, ["subject_id"], cap, F.desc("w"), *[F.col(k) for k in keys[1:]])


def steer_candidates(edges: DataFrame, candidates: DataFrame, frontier: DataFrame) -> DataFrame:
    """For each candidate (id) the weight of its edges with the frontier (id), their number and the frontier ids covered."""
    c, f = candidates.select(F.col("id").alias("candidate")).distinct(), frontier.select(F.col("id").alias("covered")).distinct()
    w = (F.col("rank") * walk_edge_weight()).alias("w")
    out = edges.join(c, F.col("subject_id") == F.col("candidate")).join(f, F.col("object_id") == F.col("covered")).select("candidate", "covered", w)
    into = edges.join(c, F.col("object_id") == F.col("candidate")).join(f, F.col("subject_id") == F.col("covered")).select("candidate", "covered", w)
    got = out.union(into).groupBy("candidate").agg(F.sum("w").alias("steer"), F.count("*").alias("edges"), F.countDistinct("covered").alias("covered"))
    return got.withColumn("steer", F.col("steer") * F.log1p("covered"))
