import datetime

import pytest
from pyspark.sql import functions as F

from attesta.functions import ids
from attesta.functions.rating import ONE, Rating, uniform_period
from attesta.operators import fold

TS = datetime.datetime(2026, 1, 1)


def _evidence(spark, rows):
    named = spark.createDataFrame([(*r, TS + datetime.timedelta(days=i)) for i, r in enumerate(rows)], "s string, r string, o string, src string, c string, score_fp long, opponent_rd_fp long, ts timestamp")
    return fold.observe(named.select(ids.canonical_id("s").alias("subject_id"), ids.canonical_id("r").alias("type_id"), ids.canonical_id("o").alias("object_id"), ids.source_id("src").alias("source_id"), ids.canonical_id("c").alias("context_id"), "score_fp", "opponent_rd_fp", "ts"))


def test_repeats_merge_and_sources_stay_apart(spark):
    e = _evidence(spark, [("a", "r", "b", "s1", None, ONE, 30 * ONE)] * 3 + [("a", "r", "b", "s2", None, 0, 30 * ONE), ("a", "r", None, "s1", None, ONE // 2, 30 * ONE)])
    got = {(r.observation_count, r.sum_score_fp, r.outcome) for r in e.collect()}
    assert got == {(3, 3 * ONE, 2), (1, 0, 0), (1, ONE // 2, 1)}
    assert fold.merge(e, e).filter("observation_count = 6").count() == 1


def test_upsert_folds_onto_priors_and_rejects_duplicates(spark):
    e = _evidence(spark, [("a", "r", "b", "s1", None, ONE, 30 * ONE), ("a", "r", "c", "s1", None, 0, 30 * ONE)])
    first = fold.upsert(None, fold.deltas(e))
    more = _evidence(spark, [("a", "r", "b", "s2", None, ONE, 30 * ONE)] * 2)
    second = {r.witness_count: r for r in fold.upsert(first, fold.deltas(more)).collect()}
    assert set(second) == {1, 3}
    was = uniform_period(Rating(), 30 * ONE, 1, ONE)
    now = uniform_period(was, 30 * ONE, 2, 2 * ONE)
    assert (second[3].rating, second[3].rd, second[3].volatility) == now[:3] and now.rd < was.rd
    with pytest.raises(Exception, match="several deltas"):
        fold.upsert(None, fold.deltas(e).union(fold.deltas(e))).collect()


def test_evicting_a_source_leaves_what_others_said(spark):
    e = _evidence(spark, [("a", "r", "b", "s1", None, ONE, 30 * ONE), ("a", "r", "b", "s2", None, 0, 150 * ONE), ("a", "r", "c", "s2", None, ONE, 150 * ONE), ("d", "r", "b", "s1", None, ONE, 30 * ONE)]).cache()
    whole = fold.scoped_consensus(e).cache()
    gone = spark.range(1).select(ids.source_id(F.lit("s2")).alias("source_id"))
    left, consensus = fold.evict(e, whole, gone)
    assert left.count() == 2 and consensus.count() == 2
    only = {bytes(r.id): r for r in fold.scoped_consensus(left).collect()}
    assert {bytes(r.id): (r.rating, r.rd) for r in consensus.collect()} == {k: (r.rating, r.rd) for k, r in only.items()}


def test_ids(spark):
    row = spark.range(1).select(ids.composition_id(F.array(F.lit(b"a" * 16), F.lit(b"b" * 16))).alias("x"), ids.composition_id(F.array(F.lit(b"b" * 16), F.lit(b"a" * 16))).alias("y"), ids.composition_id(F.array(F.lit(b"a" * 16))).alias("z"), ids.hash128_lo(F.lit(b"\xff" * 16)).alias("lo")).first()
    assert row.x != row.y and len(row.x) == 16 and bytes(row.z) == b"a" * 16 and row.lo == -1
