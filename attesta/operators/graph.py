"""Walks, paths and closures over rated edges, level by level.

Every loop is bounded by a depth or a budget, keeps what it has visited in a written table, and moves all starts at once;
edges are joined, never collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import edge_strength, eff_mu, refuted, walk_edge_weight
from .model import cut


def _steps(edges: DataFrame, types: list[bytes] | None, directed: bool) -> DataFrame:
    """(a, b, type_id, rating, rd, witness_count, outbound) of edges that aren't refuted."""
    own = edges.filter(~refuted() & F.col("object_id").isNotNull())
    own = own if types is None else own.filter(F.col("type_id").isin(*types))
    state = ["type_id", "rating", "rd", "witness_count", *[c for c in ("rank",) if c in own.columns]]
    out = own.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), *state, F.lit(True).alias("outbound"))
    if directed:
        return out
    return out.unionByName(own.filter("subject_id <> object_id").select(F.col("object_id").alias("a"), F.col("subject_id").alias("b"), *state, F.lit(False).alias("outbound")))


def web_neighbors(edges: DataFrame, frontier: DataFrame, limit: int, types: list[bytes] | None = None) -> DataFrame:
    """For each frontier id (id) its neighbours in both directions, each by its best edge, the best `limit` of them."""
    rows = _steps(edges, types, False).join(frontier.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    one = F.row_number().over(Window.partitionBy("a", "b").orderBy(eff_mu().desc(), "type_id", F.desc("outbound")))
    best = rows.withColumn("one", one).filter("one = 1").drop("one")
    place = F.row_number().over(Window.partitionBy("a").orderBy(eff_mu().desc(), "b", "type_id"))
    return best.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def explore_web(edges: DataFrame, seeds: DataFrame, hops: int = 2, fanout: int = 10, types: list[bytes] | None = None, max_nodes: int | None = None) -> DataFrame:
    """The web around each seed (id): at every hop the `fanout` new ids with the strongest edge to any id of the hop before.

    seed, hop, a (an id of the hop before), b (the new id), type_id, rating, rd, witness_count, outbound, strength. A web has
    max_nodes ids at most, its seed among them (1 + hops * fanout if not given). Refuted edges aren't walked.
    """
    room = 1 + hops * fanout if max_nodes is None else max_nodes
    own = edges if types is None else edges.filter(F.col("type_id").isin(*types))
    own = own.filter(~refuted() & F.col("object_id").isNotNull())
    state = ["type_id", "rating", "rd", "witness_count", edge_strength().alias("strength")]
    out = own.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.lit(True).alias("outbound"), *state)
    ways = cut(out.unionByName(own.filter("subject_id <> object_id").select(F.col("object_id").alias("a"), F.col("subject_id").alias("b"), F.lit(False).alias("outbound"), *state)), "web-ways")
    seen = frontier = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct(), "web-seen")
    found = None
    for hop in range(1, hops + 1):
        left = min(fanout, room - 1 - (hop - 1) * fanout)
        if left <= 0:
            break
        reached = frontier.join(ways, F.col("at") == F.col("a")).drop("at").join(seen.select("seed", F.col("at").alias("b")), ["seed", "b"], "left_anti")
        order = F.struct((-F.col("strength")).alias("s"), "type_id", "a", (~F.col("outbound")).alias("o"))
        # one edge an id first, which needs no sort of a seed's candidates; what is sorted are distinct ids
        one = reached.groupBy("seed", "b").agg(F.min(F.struct(order.alias("k"), "rating", "rd", "witness_count")).alias("x"))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("x.k.s", "b"))
        best = one.withColumn("place", place).filter(F.col("place") <= left)
        level = cut(best.select("seed", F.lit(hop).alias("hop"), F.col("x.k.a").alias("a"), "b", F.col("x.k.type_id").alias("type_id"), F.col("x.rating").alias("rating"), F.col("x.rd").alias("rd"), F.col("x.witness_count").alias("witness_count"), (~F.col("x.k.o")).alias("outbound"), (-F.col("x.k.s")).alias("strength")), "web-level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        frontier = level.select("seed", F.col("b").alias("at"))
        seen = seen.union(frontier)
    if found is None:
        return ways.limit(0).select(F.col("a").alias("seed"), F.lit(1).alias("hop"), "a", "b", "type_id", "rating", "rd", "witness_count", "outbound", "strength")
    return found


def walk_strongest(edges: DataFrame, starts: DataFrame, depth: int = 4, types: list[bytes] | None = None) -> DataFrame:
    """From each start (id) the strongest edge out, again and again, never back: start, step, type_id, entity_id, eff_mu."""
    # of an id's edges a walk can have been at the end of `depth` before; only the best beyond these can matter
    one = _steps(edges, types, True).groupBy("a", "b").agg(F.min(F.struct((-eff_mu()).alias("k"), "type_id")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("x.k", "b"))
    best = one.withColumn("rank", rank).filter(F.col("rank") <= depth + 1)
    steps = cut(best.select("a", "b", F.col("x.type_id").alias("type_id"), (-F.col("x.k")).alias("mu")), "walk-steps")
    here = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"))
    out = None
    for step in range(1, depth + 1):
        rows = here.join(steps, F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        best = rows.groupBy("start").agg(F.min(F.struct((-F.col("mu")).alias("k"), "b", "type_id", "path")).alias("x"))
        level = cut(best.select("start", F.lit(step).alias("step"), F.col("x.type_id").alias("type_id"), F.col("x.b").alias("entity_id"), (-F.col("x.k")).alias("eff_mu"), F.col("x.path").alias("path")), "walk-level")
        out = level if out is None else out.unionByName(level)
        here = level.select("start", F.col("entity_id").alias("at"), F.concat("path", F.array("entity_id")).alias("path"))
    return out.drop("path")


def walk_branches(edges: DataFrame, starts: DataFrame, depth: int = 4, breadth: int = 5, types: list[bytes] | None = None) -> DataFrame:
    """A walk from each start (id): every id that is reached goes on by its `breadth` best edges out, no id is reached twice.

    An edge's worth is its relation's rank times its signed weight; one that isn't positive is never walked, so a walk may
    end early. At each depth ids go on in the order in which they were reached, and what one takes the next one can't.
    start, depth, place (the order in the walk's depth), parent, entity_id, type_id, mu, witness_count, path and total (the
    sum of the path's conservative ratings). edges: ranked().
    """
    own = edges if types is None else edges.filter(F.col("type_id").isin(*types))
    own = own.withColumn("base", F.col("rank") * walk_edge_weight()).filter("base > 0 and object_id is not null and subject_id <> object_id")
    best = own.groupBy(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).agg(F.min(F.struct((-F.col("base")).alias("k"), "type_id", eff_mu().alias("mu"), "witness_count")).alias("x"))
    steps = cut(best.select("a", "b", F.round(-F.col("x.k"), 12).alias("base"), F.col("x.type_id").alias("type_id"), F.col("x.mu").alias("mu"), F.col("x.witness_count").alias("witness_count")), "beam-steps")
    here = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0.0).alias("total"), F.lit(1).alias("place")).distinct()
    seen = cut(here.select("start", "at"), "beam-seen")
    out = None
    for step in range(1, depth + 1):
        rows = here.join(steps, F.col("at") == F.col("a")).drop("at").join(seen.select("start", F.col("at").alias("b")), ["start", "b"], "left_anti")
        # of its candidates an id can lose no more than those before it take
        rank = F.row_number().over(Window.partitionBy("start", "a").orderBy(F.desc("base"), "b"))
        kept = rows.withColumn("rank", rank).filter(F.col("rank") <= breadth * F.col("place"))
        chosen = kept.groupBy("start").applyInPandas(_taken(breadth), "start binary, a binary, b binary, place int")
        level = cut(chosen.join(kept.drop("place", "rank"), ["start", "a", "b"]).select("start", F.lit(step).alias("depth"), "place", F.col("a").alias("parent"), F.col("b").alias("entity_id"), "type_id", "mu", "witness_count", F.concat("path", F.array("b")).alias("path"), (F.col("total") + F.col("mu") / F.lit(1e9)).alias("total")), "beam-level")
        if level.isEmpty() and out is not None:
            break
        out = level if out is None else out.unionByName(level)
        here = level.select("start", F.col("entity_id").alias("at"), "path", "total", "place")
        seen = seen.union(level.select("start", F.col("entity_id").alias("at")))
    return out


def _taken(breadth: int):
    """Of one walk's candidates at one depth those that are taken, ids in their order, each its best that are left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out, have = set(), [], {}
        for r in rows.sort_values(["place", "rank"]).itertuples(index=False):
            b = bytes(r.b)
            if b not in taken and have.get(r.place, 0) < breadth:
                taken.add(b)
                have[r.place] = have.get(r.place, 0) + 1
                out.append((r.start, r.a, r.b, len(out) + 1))
        return pd.DataFrame(out, columns=["start", "a", "b", "place"])

    return run


def ancestry(edges: DataFrame, starts: DataFrame, types: list[bytes], depth: int = 10) -> DataFrame:
    """Everything above each start (id) along edges of positive rating: smallest depth and best rating of the last edge."""
    steps = cut(_steps(edges, types, True).filter(eff_mu() > 0).groupBy("a", "b").agg(F.max(eff_mu()).alias("mu")), "ancestry-steps")
    here = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen = cut(here, "ancestry-seen")
    out = None
    for level in range(1, depth + 1):
        rows = here.join(steps, F.col("at") == F.col("a")).groupBy("start", "b").agg(F.max("mu").alias("mu"))
        new = cut(rows.join(seen.select("start", F.col("at").alias("b")), ["start", "b"], "left_anti").withColumn("depth", F.lit(level)), "ancestry-level")
        if new.isEmpty():
            break
        out = new if out is None else out.unionByName(new)
        here = new.select("start", F.col("b").alias("at"))
        seen = seen.union(here)
    if out is None:
        return here.select("start", F.col("at").alias("ancestor_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("best_eff_mu")).limit(0)
    return out.select("start", F.col("b").alias("ancestor_id"), "depth", F.col("mu").alias("best_eff_mu"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 7, types: list[bytes] | None = None, directed: bool = False) -> DataFrame:
    """The cheapest path of each pair (source, target), an edge costing -ln(strength): nodes, types, cost.

    Labels are corrected level by level from the ends that are fewer, sources or targets, so that pairs with the same such end
    (root) share its labels. A node is walked on from only where a cheaper way to it was found, and, once all of a root's pairs
    have a way, only below the cost of the dearest. Ties go to fewer steps, then to the smaller ids, from the source on.
    """
    wanted = cut(pairs.filter("source is not null and target is not null").select("source", "target").distinct(), "path-pairs")
    ends = wanted.agg(F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets")).first()
    back = ends["targets"] < ends["sources"]
    root, other = ("target", "source") if back else ("source", "target")
    wanted = wanted.select(F.col(root).alias("root"), F.col(other).alias("other"))
    steps = _steps(edges, types, directed).withColumn("cost", -F.log(edge_strength()))
    steps = steps.groupBy("a", "b").agg(F.min(F.struct("cost", "type_id")).alias("x"))
    here, there = ("b", "a") if back else ("a", "b")
    steps = cut(steps.select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("x.cost").alias("cost"), F.col("x.type_id").alias("type_id")), "path-steps")

    def longer(path: str, by: str) -> Column:
        return F.concat(F.array(by), path) if back else F.concat(path, F.array(by))

    here = cut(wanted.select("root").distinct().withColumns({"at": F.col("root"), "g": F.lit(0.0), "nodes": F.array("root"), "types": F.array().cast("array<binary>")}), "path-here")
    best = here
    for _ in range(depth):
        ways = wanted.join(best.select("root", F.col("at").alias("other"), "g"), ["root", "other"], "left")
        bound = ways.groupBy("root").agg(F.when(F.count("g") == F.count("*"), F.max("g")).alias("bound")).filter("bound is not null")
        rows = here.join(steps, "at").select("root", F.col("next").alias("at"), (F.col("g") + F.col("cost")).alias("g"), longer("nodes", "next").alias("nodes"), longer("types", "type_id").alias("types"))
        rows = rows.join(bound, "root", "left").filter("bound is null or g < bound").drop("bound")
        order = F.struct(F.round("g", 12).alias("r"), F.size("nodes").alias("n"), "nodes", "types", "g")
        new = rows.groupBy("root", "at").agg(F.min(order).alias("x"))
        known = best.select("root", "at", F.col("g").alias("had"))
        better = new.join(known, ["root", "at"], "left").filter("had is null or x.r < round(had, 12)")
        here = cut(better.select("root", "at", F.col("x.g").alias("g"), F.col("x.nodes").alias("nodes"), F.col("x.types").alias("types")), "path-here")
        if here.isEmpty():
            break
        best = cut(best.join(here, ["root", "at"], "left_anti").unionByName(here), "path-best")
    found = wanted.join(best.withColumnRenamed("at", "other"), ["root", "other"])
    return found.select(F.col("root").alias(root), F.col("other").alias(other), "nodes", "types", F.col("g").alias("cost"))


def crawl(edges: DataFrame, seeds: DataFrame, hops: int = 3, fanout: int = 64, budget: int = 32_000, types: list[bytes] | None = None) -> DataFrame:
    """Ids around seeds (id): an id's relevance is the best of its parents' relevance times the edge's strength."""
    steps = _steps(edges, types, True)
    place = F.row_number().over(Window.partitionBy("a").orderBy(eff_mu().desc(), "b", "type_id"))
    steps = cut(steps.withColumn("place", place).filter(F.col("place") <= fanout).select("a", "b", edge_strength().alias("s")), "crawl-steps")
    here = cut(seeds.select("id").distinct().withColumns({"relevance": F.lit(1.0), "hop": F.lit(0)}), "crawl-here")
    seen = here
    for hop in range(1, hops + 1):
        rows = here.join(steps, F.col("id") == F.col("a")).groupBy("b").agg(F.max(F.col("relevance") * F.col("s")).alias("relevance"))
        new = rows.join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        here = cut(new.select(F.col("b").alias("id"), "relevance", F.lit(hop).alias("hop")), "crawl-here")
        seen = seen.unionByName(here)
    return seen.orderBy(F.desc(F.round("relevance", 12)), "id").limit(budget)


def closure(links: DataFrame, starts: DataFrame, depth: int = 32) -> DataFrame:
    """Everything below each start (id) along links (parent, child), with its smallest depth."""
    here = cut(starts.select(F.col("id").alias("root"), F.col("id").alias("at"), F.lit(0).alias("depth")).distinct(), "closure")
    out = here
    for level in range(1, depth + 1):
        new = here.join(links, F.col("at") == F.col("parent")).select("root", F.col("child").alias("at")).distinct().join(out, ["root", "at"], "left_anti")
        here = cut(new.withColumn("depth", F.lit(level)), "closure")
        if here.isEmpty():
            break
        out = out.unionByName(here)
    return out


def containers(links: DataFrame, members: DataFrame, hops: int = 1) -> DataFrame:
    """Compositions that hold each member (id), directly or over several levels, with the smallest number of hops."""
    up = links.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return closure(up, members, hops).filter("depth > 0").select(F.col("root").alias("member"), F.col("at").alias("entity_id"), F.col("depth").alias("hops"))


def containers_of_all(links: DataFrame, members: list[bytes]) -> DataFrame:
    """Compositions that hold every member."""
    own = links.filter(F.col("child").isin(*members)).groupBy(F.col("parent").alias("entity_id")).agg(F.countDistinct("child").alias("n"))
    return own.filter(F.col("n") == len(set(members))).select("entity_id")


def relation_rank_resolved(law: DataFrame, is_a: DataFrame, types: DataFrame, hops: int = 8) -> DataFrame:
    """The rank of each type (type_id): its own, or that of the nearest type above it (is_a: child, parent) that has one."""
    known = law.select("type_id", "rank")
    here = types.select("type_id", F.col("type_id").alias("at")).distinct()
    done = None
    for _ in range(hops + 1):
        got = here.join(F.broadcast(known.withColumnRenamed("type_id", "at")), "at").groupBy("type_id").agg(F.max("rank").alias("rank"))
        done = cut(got if done is None else done.unionByName(got.join(done, "type_id", "left_anti")), "ranks")
        here = cut(here.join(done, "type_id", "left_anti").join(is_a, F.col("at") == F.col("child")).select("type_id", F.col("parent").alias("at")).distinct(), "ranks-up")
        if here.isEmpty():
            break
    return types.select("type_id").distinct().join(done, "type_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
