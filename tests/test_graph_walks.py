"""Webs and walks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.rating import NEUTRAL, ONE, edge_strength, walk_edge_weight
from attesta.operators import graph, recall


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(11)
    rows = [(bytes([a]), bytes([200 + rng.randrange(2)]), bytes([b]), NEUTRAL + rng.randrange(-400, 500) * ONE, rng.randrange(30, 200) * ONE, rng.randrange(1, 9), rng.choice([0.9, 0.4])) for a in range(40) for b in rng.sample(range(40), 6)]
    table = spark.createDataFrame(rows, "subject_id binary, type_id binary, object_id binary, rating long, rd long, witness_count long, rank double").withColumn("volatility", F.lit(60_000_000).cast("long"))
    known = table.select("*", edge_strength().alias("strength"), (F.col("rank") * walk_edge_weight()).alias("base")).collect()
    return table, known


def test_explore_web_is_one_beam_a_hop(spark, web):
    table, known = web
    seeds = spark.createDataFrame([(bytes([0]),), (bytes([7]),)], "id binary")
    got = sorted((bytes(r.seed), r.hop, bytes(r.b), bytes(r.a), bytes(r.type_id), r.outbound) for r in graph.explore_web(table, seeds, 3, 4).collect())
    want = []
    for seed in (bytes([0]), bytes([7])):
        seen, frontier = {seed}, {seed}
        for hop in (1, 2, 3):
            best = {}
            for e in known:
                if e.rating + 2 * e.rd < NEUTRAL:
                    continue
                s, o = bytes(e.subject_id), bytes(e.object_id)
                for a, b, out in ((s, o, True), (o, s, False)):
                    if a in frontier and b not in seen and (out or s != o):
                        best[b] = min(best.get(b, (9,)), (-e.strength, bytes(e.type_id), a, not out))
            taken = sorted((k[0], b, k) for b, k in best.items())[:4]
            want += [(seed, hop, b, k[2], k[1], not k[3]) for _, b, k in taken]
            frontier = {b for _, b, _ in taken}
            seen |= frontier
    assert got == sorted(want)


def test_walk_branches_never_takes_what_is_refuted_or_taken(spark, web):
    table, known = web
    starts = spark.createDataFrame([(bytes([3]),), (bytes([9]),)], "id binary")
    found = graph.walk_branches(table, starts, 3, 2)
    got = sorted((bytes(r.start), r.depth, r.place, bytes(r.parent), bytes(r.entity_id), round(r.total, 6)) for r in found.collect())
    best = {}
    for e in known:
        if e.base > 0 and e.subject_id != e.object_id:
            key = bytes(e.subject_id), bytes(e.object_id)
            best[key] = min(best.get(key, (9,)), (-e.base, bytes(e.type_id), e.rating - 2 * e.rd))
    want = []
    for start in (bytes([3]), bytes([9])):
        seen, level = {start}, [(start, 0.0)]
        for depth in (1, 2, 3):
            new = []
            for at, total in level:
                options = sorted((round(k[0], 12), b, k[2]) for (a, b), k in best.items() if a == at and b not in seen)[:2]
                for _, b, mu in options:
                    seen.add(b)
                    new.append((b, total + mu / 1e9))
                    want.append((start, depth, len(new), at, b, round(total + mu / 1e9, 6)))
            level = new
    assert got == sorted(want)
    winner = {bytes(r.start): r.total / r.depth for r in recall.complete(found).collect()}
    assert all(winner[s] == pytest.approx(max(w[5] / w[1] for w in want if w[0] == s), abs=1e-6) for s in winner)
