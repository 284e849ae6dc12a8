"""What queries do on large tables, shown on small ones."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.rating import ONE, edge_strength
from attesta.operators import converse, graph, lexical
from attesta.plans import suite, world


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_player_search_never_broadcasts_players(spark, sf_dir):
    plan = _plan(suite.QUERIES["chess_player_search"](spark, sf_dir))
    sent = plan.partition("BroadcastExchange")[2]
    assert sent and "Generate" not in sent and "Scan parquet" not in sent
    assert "Window" not in plan  # without a limit nothing is sorted by query


def _edges(spark, rows):
    rows = [(a, bytes([200 + t]), b, rating * ONE, 60 * ONE, 60_000_000, 1) for a, t, b, rating in rows]
    return spark.createDataFrame(rows, "subject_id binary, type_id binary, object_id binary, rating long, rd long, volatility long, witness_count long")


def _cheapest(ways, source, target, depth, directed):
    """All paths one after another: cost, steps, nodes, types of the first one."""
    found, level = [], [(0.0, (source,), ())]
    for k in range(depth + 1):
        found += [(round(g, 9), k, nodes, types) for g, nodes, types in level if nodes[-1] == target]
        level = [(g + cost, (*nodes, b), (*types, t)) for g, nodes, types in level for b, (cost, t) in ways.get(nodes[-1], {}).items() if b not in nodes]
    return min(found, default=None)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("few", ["source", "target"])
def test_shortest_paths_from_either_end(spark, few, directed):
    rng = random.Random(5)
    table = _edges(spark, [(bytes([a]), rng.randrange(2), bytes([b]), rng.choice([1500, 1650, 1900])) for a in range(24) for b in rng.sample([x for x in range(24) if x != a], 2)])
    pairs = [(a, b) if few == "source" else (b, a) for a in (0, 7) for b in range(0, 24, 3)]
    ways = {}
    for r in table.withColumn("cost", -F.log(edge_strength())).collect():
        a, b, step = bytes(r.subject_id), bytes(r.object_id), (r.cost, bytes(r.type_id))
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            ways.setdefault(x, {})[y] = min(step, ways.get(x, {}).get(y, step))
    asked = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "source binary, target binary")
    got = {(r.source[0], r.target[0]): (round(r.cost, 9), len(r.types), tuple(map(bytes, r.nodes)), tuple(map(bytes, r.types))) for r in graph.shortest_paths(table, asked, 4, directed=directed).collect()}
    want = {(a, b): p for a, b in pairs if (p := _cheapest(ways, bytes([a]), bytes([b]), 4, directed))}
    assert got == want


def test_paths_to_one_target_share_their_labels(spark, monkeypatch):
    """200 leaves of a hub: with labels of each pair there would be 200 x 200 of them."""
    leaf = lambda k: bytes([1, k])
    table = _edges(spark, [(leaf(k), 0, b"hub", 1700) for k in range(200)] + [(b"hub", 0, b"top", 1700)])
    pairs = spark.createDataFrame([(leaf(k), t) for k in range(200) for t in (b"top",)], "source binary, target binary")
    most, plain = [0], graph.cut

    def counting(df, name):
        out = plain(df, name)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(graph, "cut", counting)
    assert graph.shortest_paths(table, pairs, 4).count() == 200
    assert most[0] <= 2 * 201


def test_paths_read_their_own_relations(spark, sf_dir):
    read = {f.rsplit("/", 1)[1] for f in world.assertions(spark, sf_dir, ("IN_NATION", "IN_REGION")).inputFiles()}
    assert read == {"customer.parquet", "supplier.parquet", "nation.parquet"}


def test_concept_peers_of_shared_profiles(spark):
    """Several concepts a word, ratings that differ, words with the same concepts: every pair, one after another."""
    rng = random.Random(9)
    links = {(bytes([1, w]), bytes([2, c])): rng.choice([1600, 1700]) for w in range(40) for c in rng.sample(range(4), rng.choice([1, 1, 2]))}
    table = _edges(spark, [(w, 0, c, r) for (w, c), r in links.items()])
    asked = sorted({w for w, _ in links})[::2]
    want = set()
    for w in asked:
        near = {}
        for (a, c), r in links.items():
            for b in {x for x, d in links if d == c} if a == w else ():
                if b != w:
                    near.setdefault(b, []).append(min(r, links[b, c]) * ONE - 120 * ONE)
        want |= {(w, b, len(v), max(v)) for b, v in sorted(near.items(), key=lambda x: (-len(x[1]), -max(x[1]), x[0]))[:3]}
    words = spark.createDataFrame([(w,) for w in asked], "word binary")
    got = lexical.concept_peers(table, words, [bytes([200])], 3)
    assert {(bytes(r.word), bytes(r.peer), r.shared, r.strength) for r in got.collect()} == want


def _rows_of_operators(df):
    """Numbers of rows that the operators of a plan put out, after it has run."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if hasattr(p, "finalPhysicalPlan") and "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


def test_concept_peers_makes_no_pairs_of_words(spark):
    table = _edges(spark, [(bytes([1, k]), 0, b"concept", 1700) for k in range(200)])
    words = table.select(F.col("subject_id").alias("word"))
    rows = _rows_of_operators(lexical.concept_peers(table, words, [bytes([200])], 3))
    assert rows and max(rows) <= 200 * 4


def test_infer_never_pairs_all_prompts_with_a_context(spark):
    """100 prompts whose context 100 things lead to, while each prompt's topic has one object."""
    topic, thing = (lambda k: bytes([1, k])), (lambda k: bytes([2, k]))
    table = _edges(spark, [(topic(k), 0, thing(k), 1700) for k in range(100)] + [(thing(k), 1, b"context", 1700) for k in range(100)] + [(thing(0), 0, b"context", 1700), (topic(0), 0, thing(100), 1900)])
    topics = spark.createDataFrame([(k, topic(k)) for k in range(100)], "prompt_id long, id binary")
    context = spark.createDataFrame([(k, b"context") for k in range(99) for _ in "ab"], "prompt_id long, id binary")
    out = converse.infer(table, topics, context)
    rows = _rows_of_operators(out)
    got = {(r.prompt_id, bytes(r.object_id)): (r.bias_hits, r.place) for r in out.collect()}
    assert got == {(k, thing(k)): (int(k < 99), 1) for k in range(100)} | {(0, thing(100)): (0, 2)}
    assert rows and max(rows) <= 1000
